"""Operator 6: quality score from random Fourier features of document statistics.

Every whole text becomes a row of statistics (``STATISTICS``). Standardised,
they pass through ``FEATURES`` random cosines, which approximate a Gaussian
kernel. Each task sums its part of the normal equations, the sums are added,
and one ridge solution gives the raw score. Isotonic regression on rows kept
apart turns raw scores into probabilities.

The fit uses at most about ``max_train_docs`` labelled rows, half of either
label where there are so many, drawn by a hash of the id (one fifth of them
calibrate, weighted back to the shares of the labels), in ``FIT_TASKS`` partial sums, so what
the driver adds up has a fixed size. Null or empty text: all statistics zero,
scored like any other. Without rows of both labels every score is the share of
label 1 (0.5 without rows). Null ids and repeated rows are scored one by one.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .line_dedup import _line_keys
from .util import arrow_map, drawn, materialize

MAX_TRAIN_DOCS = 20_000
FIT_TASKS = 16
FEATURES = 256
RIDGE = 1.0
SEED = 6

STATISTICS = ("log_words", "log_lines", "word_length", "symbols", "exclamations", "bars", "capitals", "digits", "wide", "distinct_words",
              "same_as_last_word", "repeated_lines", "words_ending_in_symbol", "capital_words", "punctuation")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]=+_~^\\@")] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,;:!?")] = True


def _statistics(b: pa.Array) -> np.ndarray:
    buf, off = T.flat(b)
    out = [np.zeros((0, len(STATISTICS)))]
    for i, j in T.slices(off):
        out.append(_slice_statistics(buf[off[i]:off[j]], off[i:j + 1] - off[i]))
    return np.concatenate(out)


def _slice_statistics(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    def per_row(flags):
        c = np.concatenate([[0], np.cumsum(flags)])
        return (c[off[1:]] - c[off[:-1]]).astype(float)

    starts, ends, first = T.words(x, off)
    row, n = T.owner(first), len(off) - 1
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    lead = (x & 0xC0) != 0x80
    capital = (x >= 65) & (x <= 90)
    chars = np.maximum(per_row(lead & ~T.SPACE[x]), 1)
    h = T.span_hash(x, starts, ends)
    of_row = lambda flags: np.bincount(row[flags], minlength=n)[:n].astype(float)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)[:n]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    _, _, lf, ks, ke, size = _line_keys(x, off)
    lrow = T.owner(lf)
    at = np.flatnonzero(size > 0)
    lh = T.span_hash(x, ks[at], ke[at])
    o = np.lexsort((lh, lrow[at]))
    again = np.zeros(len(at), bool)
    again[1:] = (lh[o][1:] == lh[o][:-1]) & (lrow[at][o][1:] == lrow[at][o][:-1])
    lines = np.bincount(lrow[at], minlength=n)[:n].astype(float)
    repeated = np.bincount(lrow[at][o][again], minlength=n)[:n]
    caps = np.concatenate([[0], np.cumsum(capital)])
    small = np.concatenate([[0], np.cumsum((x >= 97) & (x <= 122))])
    shout = (caps[ends] - caps[starts] > 1) & (small[ends] == small[starts])
    return np.column_stack([
        np.log1p(words), np.log1p(lines), np.minimum(chars / some, 40), np.sqrt(per_row(_SYMBOL[x]) / chars), np.sqrt(per_row(x == 33) / chars),
        np.sqrt(per_row(x == 124) / chars), per_row(capital) / chars, np.sqrt(per_row((x >= 48) & (x <= 57)) / chars), per_row((x >= 0xC2)) / chars,
        np.minimum(distinct / some, 1), of_row(same) / some, repeated / np.maximum(lines, 1), of_row(_SYMBOL[x[ends - 1]] if len(ends) else np.zeros(0, bool)) / some,
        of_row(shout) / some, np.sqrt(per_row(_POINT[x]) / chars)])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    ridge: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, s: np.ndarray) -> np.ndarray:
        z = np.clip((s - self.mean) / self.scale, -8, 8)
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(len(STATISTICS), FEATURES)) / np.sqrt(len(STATISTICS))
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        return np.column_stack([np.ones(len(s)), np.sqrt(2 / FEATURES) * np.cos(z @ w + phase)])

    def raw(self, s: np.ndarray) -> np.ndarray:
        if self.ridge is None:
            return np.zeros(len(s))
        return np.concatenate([self.features(s[k:k + 4096]) @ self.ridge for k in range(0, len(s), 4096)] or [np.zeros(0)])

    def probability(self, s: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(s), self.knots, self.values), 0, 1)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: doc_id, score."""
        sent = docs.sparkSession.sparkContext.broadcast(self)

        def run(b: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.probability(_statistics(b.column(1))), pa.float64())], names=["doc_id", "score"])

        return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, score double")


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and increasing values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of x
    for a, b, w in zip(x[order], y[order], weight[order]):
        blocks.append([float(b), float(w), float(a * w)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, s = blocks.pop()
            p = blocks[-1]
            p[0] = (p[0] * p[1] + m * n) / (p[1] + n)
            p[1] += n
            p[2] += s
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train_docs: int = MAX_TRAIN_DOCS) -> QualityModel:
    zero, one = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
    names = [f"s{k}" for k in range(len(STATISTICS))]
    schema = "part int, y double, " + ", ".join(f"{c} double" for c in names)
    half = max_train_docs // 2
    picked, _, rate = drawn(labels, label_col, id_col, {0: half, 1: half}, 6)

    def run(b: pa.RecordBatch):
        s = _statistics(b.column(0))
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(1).cast(pa.float64()), *[pa.array(s[:, k].copy()) for k in range(s.shape[1])]], names=["part", "y", *names])

    # the draw is bounded by max_train_docs, so it may be sent to every task
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    sample = materialize(arrow_map(rows.select("text", "y", (F.col("h") % 5).cast("int").alias("part")).repartition(FIT_TASKS), run, schema))
    got = sample.agg(F.count("y"), F.sum("y"), *[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    if not got[0] or got[1] in (0, got[0]):
        return QualityModel(zero, one, None, np.zeros(1), np.array([got[1] / got[0] if got[0] else 0.5]))
    k = len(names)
    mean, scale = np.array(got[2:2 + k], float), np.array(got[2 + k:], float)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1), None, np.zeros(1), np.zeros(1))
    size = FEATURES + 1

    def normal(batches):
        g = np.zeros((size, size + 1))
        for b in batches:
            s = np.column_stack([np.asarray(b.column(f"s{k}")) for k in range(len(STATISTICS))])
            z = model.features(s)
            g += z.T @ np.column_stack([z, np.asarray(b.column("y"))])
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["sums"])

    sums = sample.where("part > 0").repartition(FIT_TASKS).mapInArrow(normal, "sums binary").collect()
    g = sum(np.frombuffer(bytes(r["sums"])).reshape(size, size + 1) for r in sums)
    penalty = np.eye(size) * RIDGE
    penalty[0, 0] = 1e-6
    model = QualityModel(model.mean, model.scale, np.linalg.solve(g[:, :size] + penalty, g[:, size]), np.zeros(1), np.zeros(1))
    apart = sample.where("part = 0").toPandas()
    if not len(apart):
        apart = sample.toPandas()
    y = apart["y"].to_numpy()
    x, y = isotonic(model.raw(apart[names].to_numpy()), y, np.where(y > 0, 1 / rate[1], 1 / rate[0]))
    return QualityModel(model.mean, model.scale, model.ridge, x, y)
