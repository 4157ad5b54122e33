"""Operator 5: benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits in lower case (ASCII and Latin-1), hashed to ``COLUMNS``.

1. Document frequencies of the columns come from all documents.
2. A randomised SVD of TF-IDF passages gives a latent space of ``RANK``
   dimensions: passages times a random test matrix, summed by task (``AT A
   Omega``), orthonormalised, then one more pass for the small Gram matrix. The
   fit uses all passages of all documents and all benchmark items, which the pass of
   step 1 stores (``_counted``).
3. Every document (of it, what the filter of step 4 leaves) is cut into overlapping passages of ``LENGTHS`` words. A
   passage's vector is a sum of word vectors, so each word is looked up once
   and passages are sums of blocks. Benchmark items are the stated query set:
   they are compared with all passages, ``ITEM_BLOCK`` items at a time, and a
   cosine of ``min_cosine`` makes a candidate.
4. The latent search may miss short, long and paraphrased items, so an exact
   count filter adds every other window that step 5 could accept. If ``need`` of
   an item's m words are in a window, then at least t of its m - need + t rarest
   ones are. Windows with that many are kept if they hold enough words of the
   item, or fewer together with the answer's.
5. A candidate's surroundings are compared with the item word by word: the
   longest common subsequence with a window of twice the item's length must hold
   ``min_lcs`` of the item, or ``min_paraphrase`` of it together with the answer:
   ``ANSWER_SHARE`` of the words of the item's last sentence, in order. So each
   pair of a document and an item that all windows would give is found.

Items travel with the tasks, up to ``MAX_ITEM_WORDS`` words of benchmark
(checked); a larger benchmark has to be searched in several calls.

Null or empty texts and items match nothing. Repeated rows are judged one by
one. Null ids are searched too and come back as null. Equal cosines and lengths
go to the smaller start. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .util import arrow_map, materialize

COLUMNS = 1 << 13
RANK = 64
OVERSAMPLE = 16
LENGTHS = (16, 32, 64)
STEP = 4
FIT_TASKS = 16
#: passages that the fit multiplies at once
PASSAGES = 64
ITEM_BLOCK = 1024
FILTER_BLOCK = 256
#: t of the count filter, as a share of the item's words; any value gives the same result
FILTER_SHARE = 0.15
FILTER_WORDS = 1 << 21
MAX_ITEM_WORDS = 5_000_000
MIN_COSINE = 0.6
MIN_LCS = 0.75
MIN_PARAPHRASE = 0.5
ANSWER_SHARE = 0.8

_CHAR = np.zeros(256, bool)
_CHAR[48:58] = _CHAR[65:91] = _CHAR[97:123] = _CHAR[128:] = True
_SENTENCE = re.compile(r"[.!?]\s+")


def _words(buf, off):
    """(hashes, row boundaries)"""
    x = T.lowered(buf)
    starts, ends, first = T.runs(_CHAR[x], off)
    return T.span_hash(x, starts, ends), first


def _column(h):
    return (h >> np.uint64(64 - COLUMNS.bit_length() + 1)).astype(np.int64)


def _one(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _words(raw, np.array([0, len(raw)]))[0]


_COUNTED = "columns binary, df binary"


def _counted(docs: DataFrame) -> DataFrame:
    """A stored row for each passage of ``LENGTHS[-1]`` words (one document each): the columns of
    its words, in order; and one for each task: in how many of its documents each column occurs (df)."""
    def run(batches):
        df = np.zeros(COLUMNS, np.int64)
        for b in batches:
            buf, off = T.flat(b.column(0))
            for i, j in T.slices(off):
                h, first = _words(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                if not len(h):
                    continue
                row = T.owner(first)
                new = np.flatnonzero(np.append(True, row[1:] != row[:-1]) | ((np.arange(len(h)) - first[row]) % LENGTHS[-1] == 0))
                size = np.diff(np.append(new, len(h)))
                key = np.repeat(np.arange(len(new)), size) * COLUMNS + _column(h)
                key = np.sort(key.astype(np.int32) if len(new) * COLUMNS < 1 << 31 else key)
                once = key[np.append(True, key[1:] != key[:-1])]
                once = np.sort(row[new].astype(key.dtype)[once // COLUMNS] * COLUMNS + once % COLUMNS)
                df += np.bincount(once[np.append(True, once[1:] != once[:-1])] % COLUMNS, minlength=COLUMNS)
                yield pa.RecordBatch.from_arrays([_cut((key % COLUMNS).astype(np.uint16), size), pa.nulls(len(new), pa.binary())], names=["columns", "df"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], names=["columns", "df"])

    return materialize(docs.select(F.col("text").cast("string")).mapInArrow(run, _COUNTED))


def _cut(x: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of so many numbers of x each."""
    off = np.append(0, np.cumsum(size * x.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(x)])


def document_frequency(counted: DataFrame) -> np.ndarray:
    """In how many documents each column occurs."""
    def run(batches):
        total = np.zeros(COLUMNS, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])

    got = counted.where("df is not null").select("df").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(COLUMNS, np.int64)
    for r in got:
        df[r["c"]] = r["n"]
    return df


def _summed(counted: DataFrame, idf: np.ndarray, m: np.ndarray, transposed: bool) -> np.ndarray:
    """AT (A m), or (A m)T (A m), of the TF-IDF rows A of unit length of all passages: sums
    by task, added up by row in the order of the tasks."""
    shape = (COLUMNS, m.shape[1]) if transposed else (m.shape[1], m.shape[1])
    sent = counted.sparkSession.sparkContext.broadcast((idf, (idf[:, None] * m).astype(np.float32)))

    def run(batches):
        idf, m = sent.value
        total = np.zeros(shape)
        for b in batches:
            if not b.num_rows:
                continue
            data, cut = T.flat(b.column(0))
            c, cut = data.view(np.uint16), cut // 2
            row = T.owner(cut)
            at = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (row[1:] != row[:-1])))
            w = np.diff(np.append(at, len(c))) * idf[c[at]]
            norm = np.maximum(np.sqrt(np.bincount(row[at], weights=w * w)), 1e-12).astype(np.float32)[:, None]
            z = np.empty((b.num_rows, m.shape[1]), np.float32)
            for i in range(0, len(z), PASSAGES):
                j = min(i + PASSAGES, len(z))
                z[i:j] = np.add.reduceat(m[c[cut[i]:cut[j]]], cut[i:j] - cut[i], axis=0)
            z /= norm
            if not transposed:
                total += z.T.astype(float) @ z
                continue
            z /= norm
            order = np.argsort(c, kind="stable")
            row, c = row[order], c[order]
            new = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
            i = 0
            while i < len(new) - 1:
                j = max(i + 1, int(np.searchsorted(new, new[i] + PASSAGES * LENGTHS[-1], "right")) - 1)
                total[c[new[i:j]]] += np.add.reduceat(z[row[new[i]:new[j]]], new[i:j] - new[i], axis=0)
                i = j
        if transposed:
            total *= idf[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array(np.full(shape[0], TaskContext.get().partitionId())),
                                          pa.array([x.tobytes() for x in total], pa.binary())], names=["c", "task", "part"])

    def add(batches):
        total, some = np.zeros(shape), np.zeros(shape[0], bool)
        for b in batches:
            c = b.column(0).to_numpy()
            np.add.at(total, c, T.flat(b.column(2))[0].view(np.float64).reshape(len(c), -1))
            some[c] = True
        at = np.flatnonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in total[at]], pa.binary())], names=["c", "part"])

    parts = counted.where("df is null").select("columns").mapInArrow(run, "c long, task long, part binary")
    total = np.zeros(shape)
    for r in parts.repartition(FIT_TASKS, "c").sortWithinPartitions("c", "task").mapInArrow(add, "c long, part binary").collect():
        total[r["c"]] = np.frombuffer(bytes(r["part"]))
    return total


def _drawn(docs: DataFrame, share: float) -> DataFrame:
    """About that share of the distinct rows: neither null ids nor copies go in as a whole."""
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(5)), F.lit(1_000_000))
    return docs.where(h < share * 1_000_000).dropDuplicates(["doc_id", "text"])


def fit_space(counted: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Word vectors: idf times the first right singular vectors, each over its singular value."""
    omega = np.random.default_rng(5).normal(size=(COLUMNS, rank + OVERSAMPLE))
    q, _ = np.linalg.qr(_summed(counted, idf, omega, True))
    value, turn = np.linalg.eigh(_summed(counted, idf, q, False))
    top = np.argsort(-value)[:rank]
    # whitened: what all passages of a language share would else outweigh what tells them apart
    v = q @ turn[:, top] / np.sqrt(np.maximum(value[top], 1e-9 * max(value.max(), 1e-9)))
    return (v * idf[:, None]).astype(np.float32)


def lcs(a: list[int], b: list[int], marks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence (bit-parallel over a)."""
    if marks is None:
        marks = _marks(a)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = marks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _marks(a: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << k
    return out


def _answer(text: str) -> list[int]:
    """Words of the last sentence; of the last eight words if it has fewer than three."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    words = _one(parts[-1]).tolist() if parts else []
    return words if len(words) >= 3 else _one(text).tolist()[-8:]


class _Filter(NamedTuple):
    """The count filter of a block of items; words are numbers in vocab."""
    base: int
    vocab: np.ndarray
    hint: np.ndarray
    size: np.ndarray
    need: np.ndarray
    full: np.ndarray
    answer_need: np.ndarray
    rare: np.ndarray  # how many rare words a window must hold
    seed_at: np.ndarray  # items that have a word among their rare ones: seed_item[seed_at[w]:][:seed_n[w]]
    seed_n: np.ndarray
    seed_item: np.ndarray
    member: np.ndarray  # word * items + item, sorted
    answer: np.ndarray


def _at_least(share: float, n: int) -> int:
    return max(1, math.ceil(share * n - 1e-9))


def _filter(items: list[tuple], base: int, df: np.ndarray, min_lcs: float, min_paraphrase: float) -> _Filter:
    words = [np.array(h, np.uint64) for _, h, _ in items]
    vocab = np.unique(np.concatenate(words))
    hint = np.zeros(1 << 16, bool)
    hint[(vocab >> np.uint64(48)).astype(np.int64)] = True
    size = np.array([len(w) for w in words])
    need = np.array([_at_least(min_paraphrase, m) for m in size])
    rare = np.minimum(need, np.maximum(1, (size * FILTER_SHARE).astype(np.int64)))
    seeds = [np.unique(w[np.argsort(df[_column(w)], kind="stable")[:m - n + t]]) for w, m, n, t in zip(words, size, need, rare)]
    word, item = np.searchsorted(vocab, np.concatenate(seeds)), np.repeat(np.arange(len(items)), [len(x) for x in seeds])
    order = np.argsort(word, kind="stable")
    seed_n = np.bincount(word, minlength=len(vocab))

    def keys(lists):
        return np.unique(np.searchsorted(vocab, np.concatenate(lists)) * len(items) + np.repeat(np.arange(len(items)), [len(x) for x in lists]))

    return _Filter(base, vocab, hint, size, need, np.array([_at_least(min_lcs, m) for m in size]), np.array([_at_least(ANSWER_SHARE, len(a)) for _, _, a in items]),
                   rare, np.cumsum(seed_n) - seed_n, seed_n, item[order], keys(words), keys([np.array(a, np.uint64) for _, _, a in items]))


def _held(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _windows(h: np.ndarray, first: np.ndarray, f: _Filter) -> Iterator[tuple[int, int, int, int]]:
    """Runs of starts whose windows pass the count filter: (row, item, first start, last start)."""
    at = np.flatnonzero(f.hint[(h >> np.uint64(48)).astype(np.int64)])
    at = at[_held(f.vocab, h[at])]
    k = np.searchsorted(f.vocab, h[at])
    word = np.full(len(h), -1)
    word[at] = k
    n = f.seed_n[k]
    total = int(n.sum())
    if not total:
        return
    pos = np.repeat(at, n)
    item = f.seed_item[np.repeat(f.seed_at[k] - (np.cumsum(n) - n), n) + np.arange(total)]
    order = np.argsort(item, kind="stable")
    pos, item = pos[order], item[order]
    row = np.searchsorted(first, pos, "right") - 1
    last = np.arange(total) + f.rare[item] - 1
    ok = last < total
    last = np.minimum(last, total - 1)
    ok &= (item[last] == item) & (row[last] == row) & (pos[last] - pos < 2 * f.size[item])
    g = np.flatnonzero(ok)
    if not len(g):
        return
    # windows of 2 m words, or the whole row, that hold the rare words from g to last
    item, row, wide = item[g], row[g], 2 * f.size[item[g]]
    top = np.maximum(first[row], first[row + 1] - wide)
    lo, hi = np.clip(pos[last[g]] - wide + 1, first[row], top), np.clip(pos[g], first[row], top)
    new = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] > hi[:-1] + 1)))
    item, row, wide, lo, hi = item[new], row[new], wide[new], lo[new], hi[np.append(new[1:], len(g)) - 1]
    size = np.minimum(hi + wide, first[row + 1]) - lo
    upto = np.cumsum(size)
    i = 0
    while i < len(item):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + FILTER_WORDS, "right")))
        begin, starts = upto[i:j] - size[i:j] - (upto[i] - size[i]), hi[i:j] - lo[i:j] + 1
        w = word[np.repeat(lo[i:j] - begin, size[i:j]) + np.arange(int(size[i:j].sum()))]
        key = np.where(w < 0, -1, w * len(f.size) + np.repeat(item[i:j], size[i:j]))
        who = np.repeat(np.arange(i, j), starts)
        step = np.arange(len(who)) - np.repeat(np.cumsum(starts) - starts, starts)
        a = begin[who - i] + step
        z = np.minimum(a + wide[who], begin[who - i] + size[who])
        words, answer = (np.append(0, np.cumsum(_held(keys, key))) for keys in (f.member, f.answer))
        held, c = words[z] - words[a], item[who]
        keep = np.flatnonzero((held >= f.full[c]) | (held >= f.need[c]) & (answer[z] - answer[a] >= f.answer_need[c]))
        if len(keep):
            cut = np.flatnonzero(np.append(True, (who[keep][1:] != who[keep][:-1]) | (np.diff(keep) > 1)))
            b, e = keep[cut], keep[np.append(cut[1:], len(keep)) - 1]
            yield from zip(row[who[b]].tolist(), (c[b] + f.base).tolist(), (lo[who[b]] + step[b]).tolist(), (lo[who[b]] + step[e]).tolist())
        i = j


_HITS = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long, n_words long"


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                      min_cosine: float = MIN_COSINE, min_lcs: float = MIN_LCS, min_paraphrase: float = MIN_PARAPHRASE, max_fit_docs: int | None = None) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, cosine,
    lcs and answer shares, first_word and n_words of the passage. The cosine of
    what only the count filter found may be below min_cosine. The latent space is fitted on all
    documents, unless a caller gives ``max_fit_docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > 6 * MAX_ITEM_WORDS:
        raise ValueError(f"the benchmark is larger than {MAX_ITEM_WORDS} words: search it in parts")
    listed = [(r["item_id"], r["text"], _one(r["text"])) for r in items.orderBy("item_id", "text").collect()]
    listed = [x for x in listed if len(x[2])]
    n_docs = docs.count()
    if not listed or not n_docs:
        return spark.createDataFrame([], _HITS)
    counted = _counted(docs)
    df = document_frequency(counted)
    idf = (np.log((1 + n_docs) / (1 + df)) + 0.01) ** 2
    if max_fit_docs is not None and n_docs > max_fit_docs:
        counted = _counted(_drawn(docs, max_fit_docs / n_docs))
    vectors = fit_space(counted.unionByName(_counted(items)), idf)
    queries = np.stack([vectors[_column(h)].sum(0) for _, _, h in listed])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    known = [(i, h.tolist(), _answer(t)) for i, t, h in listed]
    filters = [_filter(known[k:k + FILTER_BLOCK], k, df, min_lcs, min_paraphrase) for k in range(0, len(known), FILTER_BLOCK)]
    sent = spark.sparkContext.broadcast((vectors, queries.astype(np.float32), known, filters))

    def run(b: pa.RecordBatch):
        vectors, queries, items, filters = sent.value
        marks = [_marks(h) for _, h, _ in items]
        sizes = np.array([len(h) for _, h, _ in items])
        ids = b.column(0).to_pylist()
        buf, off = T.flat(b.column(1))
        rows = []
        for i, j in T.slices(off, 1 << 20):
            h, first = _words(buf[off[i]:off[j]], off[i:j + 1] - off[i])
            if not len(h):
                continue
            n = -(-len(h) // STEP)
            e = np.zeros((n * STEP, vectors.shape[1]), np.float32)
            e[:len(h)] = vectors[_column(h)]
            blocks = e.reshape(n, STEP, -1).sum(1)
            total = np.concatenate([np.zeros((1, blocks.shape[1])), np.cumsum(blocks, axis=0, dtype=np.float64)])
            best: dict[tuple[int, int], tuple] = {}
            runs = [x for f in filters for x in _windows(h, first, f)]
            n_rows = len(first) - 1
            possible = np.unique(np.array([c * n_rows + r for r, c, _, _ in runs], np.int64))
            cover = np.zeros(len(h) + 1, np.int64)
            for r, c, lo, hi in runs:
                cover[lo] += 1
                cover[min(hi + 2 * int(sizes[c]), int(first[r + 1]))] -= 1
            cover = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
            for length in LENGTHS if runs else ():
                k, hop = length // STEP, max(1, length // 4 // STEP)
                at = np.arange(0, max(1, n - k + hop), hop)
                # passages outside all windows that the count filter leaves cannot be accepted
                at = at[cover[np.minimum(at * STEP + length, len(h))] > cover[np.minimum(at * STEP, len(h))]]
                w = (total[np.minimum(at + k, n)] - total[at]).astype(np.float32)
                w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
                for q in range(0, len(queries), ITEM_BLOCK):
                    cos = w @ queries[q:q + ITEM_BLOCK].T
                    x, y = np.nonzero(cos >= min_cosine)
                    # the others have no row that the count filter leaves
                    lo, hi = (np.searchsorted(first, z, "right") - 1 for z in (at[x] * STEP, np.minimum(at[x] * STEP + length, len(h)) - 1))
                    ok = np.searchsorted(possible, (y + q) * n_rows + lo) < np.searchsorted(possible, (y + q) * n_rows + hi, "right")
                    x, y = x[ok], y[ok]
                    for a, c, s in zip((at[x] * STEP).tolist(), (y + q).tolist(), cos[x, y].tolist()):
                        _judge(a, length, c, s, h, first, items, marks, sizes, best, min_lcs, min_paraphrase)
            for r, c, lo, hi in runs:
                _judge_all(r, c, lo, hi, h, first, items, marks, best, vectors, queries, min_lcs, min_paraphrase)
            for (r, c), got in best.items():
                rows.append((ids[i + r], items[c][0], *got))
        cols = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, kinds)], names=[f.split()[0] for f in _HITS.split(", ")])

    return arrow_map(docs, run, _HITS)


def _judge(at, length, c, cosine, h, first, items, marks, sizes, best, min_lcs, min_paraphrase):
    """Compares the surroundings of a candidate passage with the item, in each
    row that the passage touches."""
    m = int(sizes[c])
    lo_row = int(np.searchsorted(first, at, "right")) - 1
    hi_row = int(np.searchsorted(first, min(at + length, len(h)) - 1, "right")) - 1
    for r in range(lo_row, hi_row + 1):
        lo, hi = max(int(first[r]), at - m), min(int(first[r + 1]), at + length + m)
        if hi - lo < min_paraphrase * m:
            continue
        old = best.get((r, c))
        if old is not None and (old[1] >= 1.0 or old[3] <= lo - int(first[r]) and old[3] + old[4] >= hi - int(first[r])):
            continue
        near = h[lo:hi].tolist()
        # the item's words may not be spread over more than twice its length
        share, where = 0.0, lo
        for s in range(0, max(1, len(near) - 2 * m + 1), max(1, m // 2)):
            got = lcs(items[c][1], near[s:s + 2 * m], marks[c]) / m
            if got > share:
                share, where = got, lo + s
        if share < min_paraphrase:
            continue
        answer = items[c][2]
        found = lcs(answer, h[where:min(hi, where + 2 * m)].tolist()) / len(answer)
        if share >= min_lcs or found >= ANSWER_SHARE:
            if old is None or share > old[1]:
                best[r, c] = (float(cosine), share, found, where - int(first[r]), min(hi, where + 2 * m) - where)


def _judge_all(r, c, lo, hi, h, first, items, marks, best, vectors, queries, min_lcs, min_paraphrase):
    """Compares the windows that start at lo to hi with the item."""
    old = best.get((r, c))
    most = old[1] if old is not None else 0.0
    words, answer = items[c][1:]
    m = len(words)
    hop, found = max(1, m // 2), None
    for s in range(lo, hi + 1, hop):
        n = min(hop, hi + 1 - s)
        near = h[s:min(int(first[r + 1]), s + n - 1 + 2 * m)].tolist()
        # no window has more than all of them together
        together = lcs(words, near, marks[c]) / m
        if together < min_paraphrase or together <= most:
            continue
        for k in range(n):
            share = lcs(words, near[k:k + 2 * m], marks[c]) / m
            if share <= most or share < min_paraphrase:
                continue
            told = lcs(answer, near[k:k + 2 * m]) / len(answer)
            if share >= min_lcs or told >= ANSWER_SHARE:
                most, found = share, (share, told, s + k, len(near[k:k + 2 * m]))
                if share >= together:
                    break
    if found is not None:
        share, told, where, n = found
        total = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors[_column(h[where:where + n])], axis=0, dtype=np.float64)])
        w = total[min(m, n):] - total[:n + 1 - min(m, n)]
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
        best[r, c] = (float((w @ queries[c]).max()), share, told, where - int(first[r]), n)
