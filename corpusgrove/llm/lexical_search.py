"""Operator 12: ranked lexical search in reverse: documents stream through an index of the items.

The items' terms form an inverted index (term, items) which every task holds.

1. Each document is read once and becomes its number of terms and the counts of
   those terms that some item has (written to the shared folder; a few bytes per
   term). Terms are looked up by a 64-bit hash and confirmed by a second one.
2. N, L and each item term's document frequency are sums over those rows.
3. The counts stream through the index: a document's terms are scored, added up
   per item, and offered to the item's heap, which keeps the ``k`` best
   documents of the task. The heaps of all tasks (k rows per item each) are merged
   per item by a grouped top-k with partial results before the shuffle.

The index is sent to every task only in blocks of at most ``max_postings``
(term, item) pairs; more items make more blocks, each of which meets all documents
(an item longer than a block is a block of its own). Weights and scores are integers. Sums are
done in doubles, which is exact: a block whose scores could reach 2**53 raises.

Null text: no term. Documents without a term are not counted. Null doc_id: counted
and ranked, after others of the same score. Rows with equal ids are documents of
their own. Items: rows with equal item_id are one item with the terms of all;
null item_id or no term: no result. Other columns are ignored, whatever their names.
Empty tables give an empty result. Very long texts are counted whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .util import arrow_map, materialize

#: best documents kept per item
TOP = 10
MAX_POSTINGS = 2_000_000
#: (document, item) sums held at once
CELLS = 1 << 21

#: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]: ASCII letters and digits, and all beyond ASCII
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True


def _terms(col: pa.Array):
    """(first hash, second hash, row boundaries) of the terms of each row, slice by slice."""
    buf, off = T.flat(col)
    for i, j in T.slices(off):
        x = T.LOWER[buf[off[i]:off[j]]]
        starts, ends, first = T.runs(TERM[x], off[i:j + 1] - off[i])
        yield i, j, x, starts, ends, first


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, h, g): the distinct terms of each item by two hashes."""
    def run(b: pa.RecordBatch):
        ids = np.asarray(b.column(0))
        for i, j, x, starts, ends, first in _terms(b.column(1)):
            row = T.owner(first)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i + row]), *[pa.array(T.span_hash(x, starts, ends, k).view(np.int64)) for k in (0, 1)]], names=["item_id", "h", "g"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    return arrow_map(rows, run, "item_id long, h long, g long").distinct()


class ItemIndex:
    """Terms (sorted by hash) of a block of items and the items that hold each."""

    def __init__(self, item: np.ndarray, h: np.ndarray, g: np.ndarray):
        self.items, at = np.unique(item, return_inverse=True)
        order = np.lexsort((at, g, h))
        h, g, at = h[order], g[order], at[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        first = np.flatnonzero(new)
        self.h, self.g, self.posting = h[first], g[first], at.astype(np.int32)
        self.bounds = np.append(first, len(h))

    def find(self, h: np.ndarray, second) -> tuple[np.ndarray, np.ndarray]:
        """(places, term numbers) of the hashes that the index holds; ``second(places)`` gives the second hashes."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        place = np.flatnonzero(self.h[at] == h)
        at, g = at[place], second(place)
        found = self.g[at] == g
        # terms with one first hash and several second ones follow each other
        while not found.all():
            on = np.flatnonzero(~found)
            at[on] += 1
            out = (at[on] >= len(self.h)) | (self.h[np.minimum(at[on], len(self.h) - 1)] != h[place[on]])
            keep = np.ones(len(at), bool)
            keep[on[out]] = False
            at, place, g, = at[keep], place[keep], g[keep]
            found = self.g[at] == g
        return place, at


def blocks(terms: DataFrame, max_postings: int = MAX_POSTINGS) -> list[ItemIndex]:
    """The items' index in blocks of whole items, about ``max_postings`` pairs each."""
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    if total <= max_postings:
        parts = [terms]
    else:
        dealt = materialize(terms.join(sizes.withColumn("block", F.floor(before / max_postings)).select("item_id", "block"), "item_id"))
        parts = [dealt.where(F.col("block") == r["block"]) for r in dealt.select("block").distinct().orderBy("block").collect()]
    out = []
    for p in parts:
        t = p.select("item_id", "h", "g").toPandas()
        out.append(ItemIndex(*(t[c].to_numpy() for c in ("item_id", "h", "g"))))
    return out


def term_counts(docs: DataFrame, index: ItemIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, term, tf) per document with a term: its number of terms, and the
    index's terms (int32 numbers) with their counts (int64), as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(b: pa.RecordBatch):
        ids, ix = b.column(0), sent.value
        for i, j, x, starts, ends, first in _terms(b.column(1)):
            h = T.span_hash(x, starts, ends).view(np.int64)
            place, term = ix.find(h, lambda p: T.span_hash(x, starts[p], ends[p], 1).view(np.int64))
            key, tf = np.unique(T.owner(first)[place] * np.int64(len(ix.h) + 1) + term, return_counts=True)
            row, term = np.divmod(key, len(ix.h) + 1)
            some = np.flatnonzero(np.diff(first))
            at = np.searchsorted(row, np.append(some, j - i))
            term, tf = term.astype(np.int32), tf.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(i + some)), pa.array(np.diff(first)[some].astype(np.int64)),
                 pa.array([term[p:q].tobytes() for p, q in zip(at[:-1], at[1:])], pa.binary()), pa.array([tf[p:q].tobytes() for p, q in zip(at[:-1], at[1:])], pa.binary())],
                names=["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return materialize(arrow_map(rows, run, "doc_id long, n long, term binary, tf binary"))


def statistics(counts: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, document frequency of each index term)."""
    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            t = b.column(0)
            got, _ = T.flat(t)
            df += np.bincount(np.frombuffer(got.tobytes(), np.int32), minlength=n_terms)
        at = np.flatnonzero(df)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k:k + (1 << 16)]), pa.array(df[at[k:k + (1 << 16)]])], names=["term", "df"])

    r = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(n_terms, np.int64)
    got = counts.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df[got["term"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    return int(r["n"]), int(r["l"] or 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1)))"""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class _Heaps:
    """The k best (score, null id last, id) of every item, as arrays."""

    def __init__(self, k: int):
        self.k = k
        self.item, self.score, self.null, self.doc = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        self.floor: np.ndarray | None = None

    def offer(self, item, score, null, doc, n_items: int):
        if self.floor is not None:
            ok = score >= self.floor[item]
            item, score, null, doc = item[ok], score[ok], null[ok], doc[ok]
        item, score, null, doc = (np.concatenate(x) for x in zip((self.item, self.score, self.null, self.doc), (item, score, null, doc)))
        order = np.lexsort((doc, null, -score, item))
        item, score, null, doc = item[order], score[order], null[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.floor = np.zeros(n_items, np.int64)
        full = rank == self.k - 1
        self.floor[item[full]] = score[full]
        keep = rank < self.k
        self.item, self.score, self.null, self.doc = item[keep], score[keep], null[keep], doc[keep]


def _search_block(counts: DataFrame, index: ItemIndex, k: int) -> DataFrame:
    n_terms, n_items = len(index.h), len(index.items)
    n_docs, total, df = statistics(counts, n_terms)
    w = weights(n_docs, df)
    # a term's share is at most w * 10**6
    most = np.bincount(index.posting, weights=np.repeat(w, np.diff(index.bounds)).astype(float), minlength=n_items)
    if n_items and most.max() * 1e6 >= 2 ** 53:
        raise ValueError("an item's scores may reach 2**53: split the item")
    spark = counts.sparkSession
    sent = spark.sparkContext.broadcast((index.bounds, index.posting, index.items, w))

    def run(batches):
        bounds, posting, items, w = sent.value
        heaps = _Heaps(k)
        for b in batches:
            ids = b.column(0)
            null = np.asarray(ids.is_null())
            doc, n = np.asarray(ids.fill_null(0)), np.asarray(b.column(1))
            tb, toff = T.flat(b.column(2))
            fb, foff = T.flat(b.column(3))
            fan = np.diff(bounds)
            # pieces of documents whose postings and (document, item) sums stay bounded
            term = np.frombuffer(tb.tobytes(), np.int32)
            tf = np.frombuffer(fb.tobytes(), np.int64)
            first = toff // 4
            cost = np.append(0, np.cumsum(fan[term]))[first]
            step = max(1, CELLS // max(1, n_items))
            i = 0
            while i < len(doc):
                j = min(len(doc), i + step, max(i + 1, int(np.searchsorted(cost, cost[i] + CELLS, "right")) - 1))
                t, f = term[first[i]:first[j]], tf[first[i]:first[j]]
                row = np.repeat(np.arange(j - i), np.diff(first[i:j + 1]))
                m = 100 - 90 + (90 * n[i:j] * n_docs) // total
                share = w[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[row]))
                size = fan[t]
                at = np.repeat(bounds[t] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
                key = np.repeat(row, size) * n_items + posting[at]
                sums = np.bincount(key, weights=np.repeat(share, size).astype(float), minlength=0).astype(np.int64)
                hit = np.flatnonzero(sums)
                r, item = np.divmod(hit, n_items)
                heaps.offer(item, sums[hit], null[i:j][r], doc[i:j][r], n_items)
                i = j
        yield pa.RecordBatch.from_arrays([pa.array(items[heaps.item]), pa.array(heaps.doc, mask=heaps.null), pa.array(heaps.score)], names=["item_id", "doc_id", "score"])

    best = counts.mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, max_postings: int = MAX_POSTINGS, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for index in blocks(materialize(item_terms(items, item_id, text)), max_postings):
        out = out.unionByName(_search_block(term_counts(docs, index, doc_id, text), index, k))
    return out
