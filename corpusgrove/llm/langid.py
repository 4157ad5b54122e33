"""Operator 7: language identification by multinomial naive Bayes over hashed
character n-grams.

Texts are lower-cased, and every character that is no letter becomes a blank.
Features are the 1-, 2- and 3-grams that hold a letter and no two blanks,
hashed to ``DIMS`` columns. Training counts them by language on a documented
sample of at most about ``max_train_docs`` rows per language, drawn by a hash
of the id. A rare language is used whole. Each task sums its rows first, and the
model is languages x ``DIMS`` log probabilities, which is small enough to send
to every task (``MAX_LANGS`` is checked). Scoring reads whole texts and adds up
the columns of each text's n-grams in NumPy.

``score`` is the posterior of the predicted language, with the evidence of long
texts tempered to that of ``EVIDENCE`` n-grams, so that mixed texts do not get
1.0. Null text, or text without a letter: ``und`` with score 0. Ties go to the
first language in name order. Without any training row every text is ``und``.
Null ids and repeated rows are scored like others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .util import arrow_map, rest_type, with_rest

DIMS = 1 << 15
MAX_TRAIN_DOCS = 3000
MAX_LANGS = 512
EVIDENCE = 60
SMOOTHING = 0.5
UNKNOWN = "und"

#: bytes of text expanded to n-grams at a time
SLICE = 1 << 18

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _ngrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature columns, their rows in order, letters of each row)."""
    # lower() may change a text's length, so rows are kept apart by a NUL
    parts = buf.tobytes()
    texts = [parts[a:z].decode("utf-8", "replace").replace("\0", " ").lower() for a, z in zip(off[:-1], off[1:])]
    c = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    cut = c == 0
    row = (np.cumsum(cut) - 1).astype(np.int32)
    letter = _letters()[c]
    c = np.where(letter, c, np.where(cut, np.uint64(0), np.uint64(32)))
    n_letters = np.bincount(row[letter], minlength=len(texts))[:len(texts)]
    cols, rows = [], []
    blank = ~letter
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        some, bad = np.zeros(m, bool), np.zeros(m, bool)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k:k + m]
            some |= letter[k:k + m]
            if k:
                bad |= blank[k:k + m] & blank[k - 1:k - 1 + m]
                if n == 3 and k == 1:
                    bad |= cut[1:1 + m]
        ok = np.flatnonzero(some & ~bad)
        # a row's leading NUL belongs to it; a window that ends in the next NUL still starts in the row
        cols.append((T.mix(h[ok]) >> np.uint64(65 - DIMS.bit_length())).astype(np.int32))
        rows.append(row[ok])
    col, at = np.concatenate(cols), np.concatenate(rows)
    return col, at, n_letters


_COUNTS = "lang string, counts binary"


def _count(b: pa.RecordBatch):
    langs = np.asarray(b.column(0).to_pylist(), object)
    buf, off = T.flat(b.column(1))
    total: dict[str, np.ndarray] = {}
    for i, j in T.slices(off, SLICE):
        col, row, _ = _ngrams(buf[off[i]:off[j]], off[i:j + 1] - off[i])
        for lang in set(langs[i:j]):
            mine = np.flatnonzero(langs[i:j] == lang)
            pick = np.zeros(j - i, bool)
            pick[mine] = True
            n = np.bincount(col[pick[row]], minlength=DIMS)
            total[lang] = total.get(lang, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())], names=["lang", "counts"])


def _add_up(key, table):
    total = np.zeros(DIMS, np.int64)
    for x in table.column("counts").to_pylist():
        total += np.frombuffer(x, np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    log_prob: np.ndarray  # DIMS x languages, float32
    prior: np.ndarray

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """One row per input row: doc_id, lang_pred, score, and ``rest``: a
        struct of the columns to carry along."""
        docs = with_rest(docs, id_col, text_col, carry)
        sent = docs.sparkSession.sparkContext.broadcast((self.langs, self.log_prob, self.prior))

        def run(b: pa.RecordBatch):
            langs, log_prob, prior = sent.value
            buf, off = T.flat(b.column(1))
            names, scores = [], []
            for i, j in T.slices(off, SLICE):
                col, row, letters = _ngrams(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                if not langs:
                    letters = letters * 0
                total = np.zeros((j - i, max(1, len(langs))))
                count = np.bincount(row, minlength=j - i)[:j - i]
                for k in range(len(langs)):
                    total[:, k] = np.bincount(row, weights=log_prob[k][col], minlength=j - i)[:j - i]
                total = total * (np.minimum(1.0, EVIDENCE / np.maximum(count, 1)))[:, None] + (prior if len(langs) else 0)
                best = total.argmax(1)
                p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                names.extend(langs[k] if n else UNKNOWN for k, n in zip(best, letters))
                scores.extend(np.where(letters > 0, p, 0.0).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), b.column(2)], names=["doc_id", "lang_pred", "score", "rest"])

        out = arrow_map(docs, run, f"doc_id long, lang_pred string, score double, rest {rest_type(docs)}")
        return out if carry else out.drop("rest")


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_train_docs: int = MAX_TRAIN_DOCS) -> LanguageModel:
    """Fits on rows with a language and a text; ``max_train_docs`` is about the
    most per language."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                           F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).alias("h")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return LanguageModel((), np.zeros((0, DIMS), np.float32), np.zeros(0))
    spark = labelled.sparkSession
    rates = spark.createDataFrame([(r["lang"], min(1.0, max_train_docs / r["count"])) for r in sizes], "lang string, rate double")
    sample = rows.join(F.broadcast(rates), "lang").where(F.pmod("h", F.lit(1_000_000)) < F.col("rate") * 1_000_000).select("lang", "text")
    counts = arrow_map(sample.repartition(16), _count, _COUNTS).groupBy("lang").applyInArrow(_add_up, _COUNTS).collect()
    langs = tuple(sorted(r["lang"] for r in counts))
    table = {r["lang"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in counts}
    if not langs:
        return LanguageModel((), np.zeros((0, DIMS), np.float32), np.zeros(0))
    n = np.stack([table[k] for k in langs]).astype(np.float64) + SMOOTHING
    log_prob = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
    return LanguageModel(langs, log_prob, np.zeros(len(langs)))
