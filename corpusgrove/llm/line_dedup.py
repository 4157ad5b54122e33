"""Operator 4: incremental line dedup with sharded cuckoo filters over exact
reference counts.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case. A key of at least ``min_chars`` code points that at least ``min_docs``
documents hold is repeated: all its lines go, except those of the largest
document id that holds it.

``LineIndex`` keeps three tables, all split by ``shard`` (a hash of the key):

* ``refs``: one row per line that may count (key, document, line number) - the
  exact references, from which every count can be derived again;
* ``counts``: key, documents that hold it, the largest of them;
* ``filters``: one cuckoo filter per shard over the keys in ``counts``.

``insert`` sums a batch to one row per key first, so a line that a third of all
documents share is one row. The shard's filter then tells keys that are surely
new (appended to the table as they are) from those that may exist (looked up in it). New keys
are added to the stored filters of their shards; other shards' filters stay as they are. A
filter is dealt anew from the exact table only when it is full. ``delete`` takes
references away. Only keys whose largest document went are counted again from
``refs``, and keys without references are deleted from their shards' filters.
After a deletion the tables equal those of an index that never saw the documents.

Keys are 128-bit hashes (two independent 64-bit ones). Null or empty text: one
empty line. Null ids: their lines count for no document and stay. Rows with one id
are one document (a key counts once), but each row loses its own lines: rows are told
apart by a hash of their text. Equal rows lose the same lines. Very long texts are read
whole. Columns with other names are carried in a struct, so none can clash. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .util import arrow_map, bucket_of, materialize, rest_type, text_size, with_rest

MIN_CHARS = 20
MIN_DOCS = 3
#: distinct keys of one shard, about
SHARD_KEYS = 250_000

_REFS = "doc_id long, row long, line int, lead boolean, k1 long, k2 long"
_COUNTS = "shard int, k1 long, k2 long, n_docs long, max_doc long"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; vectorised insert, contains, delete.

    A key lives in one of two buckets; each follows from the other and the
    fingerprint. Zero marks a free slot. ``insert`` is false when a key cannot be
    placed: the filter is then of no use and is dealt anew, larger (``of``). The full keys
    for that come from the exact table, since fingerprints alone cannot be dealt.
    """

    SLOTS = 4

    def __init__(self, capacity: int = 1, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(capacity / 0.8 / self.SLOTS)) - 1).bit_length()
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 1) -> CuckooFilter:
        size = max(1, len(keys) * room)
        while True:
            f = cls(size)
            if f.insert(keys):
                return f
            size *= 2

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = T.mix(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        a = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, a, self.other(a, mark)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        step = T.mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)
        return bucket ^ step.astype(np.int64)

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts each mark in a free slot of its bucket; returns those left over."""
        left = np.arange(len(mark))
        for s in range(self.SLOTS):
            free = left[self.table[bucket[left], s] == 0]
            first = np.unique(bucket[free], return_index=True)[1]
            put = free[first]
            self.table[bucket[put], s] = mark[put]
            done = np.zeros(len(mark), bool)
            done[put] = True
            left = left[~done[left]]
        return left

    def insert(self, keys: np.ndarray, kicks: int = 500) -> bool:
        mark, a, b = self.places(keys)
        left = self._settle(mark, a)
        left = left[self._settle(mark[left], b[left])]
        for m, bucket in zip(mark[left], b[left]):  # a few in a hundred: throw out another one
            for k in range(kicks):
                row = self.table[bucket]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = m
                    break
                slot = k % self.SLOTS
                m, row[slot] = row[slot].copy(), m
                bucket = int(self.other(np.array([bucket]), np.array([m]))[0])
            else:
                return False
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        mark, a, b = self.places(keys)
        for m, x, y in zip(mark, a, b):
            for bucket in (x, y):
                at = np.flatnonzero(self.table[bucket] == m)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def _line_keys(buf: np.ndarray, off: np.ndarray):
    """Lines of each row (split at \\n): (starts, ends, first line of each row,
    key starts, key ends, code points of the key)."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    # a break at the very end of a row opens an empty line of that row, which
    # sorts beside the next row's first line: count lines by row instead
    n_lines = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(n_lines)])
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = off[1:]
    solid = np.concatenate([[0], np.cumsum(~T.SPACE[buf])])
    at = np.flatnonzero(~T.SPACE[buf])
    some = solid[ends] > solid[starts]
    ks, ke = starts.copy(), starts.copy()
    if len(at):
        ks[some] = at[solid[starts[some]]]
        ke[some] = at[solid[ends[some]] - 1] + 1
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return starts, ends, first, ks, ke, lead[ke] - lead[ks]


def _references(min_chars: int):
    def run(b: pa.RecordBatch):
        ids = b.column(0)
        buf, off = T.flat(b.column(1))
        for i, j in T.slices(off):
            x, o = T.LOWER[buf[off[i]:off[j]]], off[i:j + 1] - off[i]
            starts, _, first, ks, ke, chars = _line_keys(x, o)
            row = T.owner(first)
            at = np.flatnonzero(chars >= min_chars)
            k1, k2 = T.span_hash(x, ks[at], ke[at]), T.span_hash(x, ks[at], ke[at], 1)
            order = np.lexsort((at, k2, k1, row[at]))
            lead = np.ones(len(at), bool)
            r, p, q = row[at][order], k1[order], k2[order]
            lead[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(r + i)), b.column(2).take(pa.array(r + i)), pa.array((at - first[row[at]])[order].astype(np.int32)), pa.array(lead),
                pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], names=[f.split()[0] for f in _REFS.split(", ")])
    return run


def _drop_lines(b: pa.RecordBatch):
    ids, dropped = b.column(0), b.column(2)
    buf, off = T.flat(b.column(1))
    gone = np.asarray(dropped.flatten()).astype(np.int64)
    n_gone = np.asarray(dropped.fill_null([]).value_lengths()).astype(np.int64)
    first_gone = np.concatenate([[0], np.cumsum(n_gone)])
    for i, j in T.slices(off):
        x, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        starts, ends, first, *_ = _line_keys(x, o)
        keep = np.ones(len(starts), bool)
        size = n_gone[i:j]
        at = np.repeat(first[:-1], size) + gone[first_gone[i]:first_gone[j]]
        keep[at] = False
        row = T.owner(first)
        s, e, r = starts[keep], ends[keep], row[keep]
        # a kept line takes its break along unless it is the row's last kept one
        more = np.append(r[1:] == r[:-1], False) if len(r) else np.zeros(0, bool)
        edge = np.zeros(len(x) + 1, np.int32)
        np.add.at(edge, s, 1)
        np.add.at(edge, e, -1)
        edge[e[more]] += 1  # the break's own byte
        np.add.at(edge, e[more] + 1, -1)
        own = np.cumsum(edge[:-1]) > 0
        size = np.concatenate([[0], np.cumsum(own)])
        text = pa.StringArray.from_buffers(j - i, pa.py_buffer(size[o].astype(np.int32).tobytes()), pa.py_buffer(buf[off[i]:off[j]][own].tobytes()))
        yield pa.RecordBatch.from_arrays([
            ids.slice(i, j - i), pa.array(np.diff(first), pa.int64()),
            pa.array(np.diff(first) - np.add.reduceat(np.append(keep, False).astype(np.int64), first[:-1]), pa.int64()), text,
            b.column(3).slice(i, j - i)],
            names=["doc_id", "n_lines", "n_dropped", "kept_text", "rest"])


def _test(key, rows, filters):
    """Marks the keys that the shard's filter may hold."""
    keys = np.asarray(rows.column("k1").combine_chunks()).view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
    seen = CuckooFilter.from_bytes(filters.column("data")[0].as_py()).contains(keys) if filters.num_rows and len(keys) else np.zeros(len(keys), bool)
    return rows.append_column("seen", pa.array(seen, pa.bool_()))


def _shard(key, data: bytes | None):
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})


def _keys(rows) -> np.ndarray:
    return np.asarray(rows.column("k1").combine_chunks()).view(np.uint64)


def _build(key, rows):
    # room for as many keys again, so that the next insertions find a place
    return _shard(key, CuckooFilter.of(_keys(rows), room=2).to_bytes())


def _extend(key, rows, filters):
    """The shard's filter with the new keys; null if it is full."""
    if not filters.num_rows:
        return _build(key, rows)
    if not rows.num_rows:
        return _shard(key, filters.column("data")[0].as_py())
    f = CuckooFilter.from_bytes(filters.column("data")[0].as_py())
    return _shard(key, f.to_bytes() if f.insert(_keys(rows)) else None)


def _shrink(key, rows, filters):
    """The shard's filter without the keys."""
    if not filters.num_rows:
        return _shard(key, None).slice(0, 0)
    f = CuckooFilter.from_bytes(filters.column("data")[0].as_py())
    f.delete(_keys(rows) if rows.num_rows else np.zeros(0, np.uint64))
    return _shard(key, f.to_bytes())


@dataclass(frozen=True)
class LineIndex:
    """State of the dedup; every step gives a new one."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 16, min_chars: int = MIN_CHARS) -> LineIndex:
        make = lambda schema: spark.createDataFrame([], schema)
        return cls(make(_REFS), make(_COUNTS), make("shard int, data binary"), shards, min_chars)

    def references(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Lines of ``docs`` that may count."""
        text = F.col(text_col).cast("string")
        docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text, F.xxhash64(text))
        return arrow_map(docs, _references(self.min_chars), _REFS)

    def _summed(self, refs: DataFrame) -> DataFrame:
        # an id may come in several rows: a document counts once
        return (refs.where("lead").select("k1", "k2", "doc_id").distinct().groupBy("k1", "k2")
                .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
                .withColumn("shard", bucket_of("k1", self.shards)).select(*[c.split()[0] for c in _COUNTS.split(", ")]))

    def _changed(self, keys: DataFrame, change, counts: DataFrame) -> DataFrame:
        """The filters after a change by ``keys(shard, k1)``: filters of other shards as
        they are, full ones built anew from the counts. Not computed before it is used."""
        schema = "shard int, data binary"
        touched = keys.select("shard").distinct()
        done = keys.groupBy("shard").cogroup(self.filters.join(touched, "shard", "left_semi").groupBy("shard")).applyInArrow(change, schema)
        full = counts.join(done.where("data is null").select("shard"), "shard", "left_semi")
        return (self.filters.join(touched, "shard", "left_anti").unionByName(done.where("data is not null"))
                .unionByName(full.select("shard", "k1").groupBy("shard").applyInArrow(_build, schema)))

    def settled(self) -> LineIndex:
        """The index with its filters written, as the next change needs them."""
        return replace(self, filters=materialize(self.filters))

    def insert(self, docs: DataFrame | None = None, refs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Adds documents (or their ``references``) whose ids are not in the index yet."""
        refs = materialize(self.references(docs, id_col, text_col)) if refs is None else refs
        was = self.settled()
        tested = materialize(was._summed(refs).groupBy("shard").cogroup(was.filters.groupBy("shard")).applyInArrow(_test, _COUNTS + ", seen boolean"))
        key = ["shard", "k1", "k2"]
        seen = tested.where("seen").select(*key, F.col("n_docs").alias("more"), F.col("max_doc").alias("new_max"))
        # what the filter has not seen is appended; the rest changes or joins rows of the table
        both = self.counts.join(seen, key, "full").withColumn("fresh", F.col("n_docs").isNull())
        both = materialize(both.select(*key, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"),
                                       F.greatest("max_doc", "new_max").alias("max_doc"), "fresh")
                           .unionByName(tested.where("not seen").select(*key, "n_docs", "max_doc", F.lit(True).alias("fresh"))))
        counts = both.drop("fresh")
        return replace(was, refs=self.refs.unionByName(refs), counts=counts, filters=was._changed(both.where("fresh").select("shard", "k1"), _extend, counts))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Takes the documents with these ids out again."""
        ids = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        gone = self._summed(self.refs.join(ids, "doc_id", "left_semi")).select("shard", "k1", "k2", F.col("n_docs").alias("less"), F.col("max_doc").alias("gone_max"))
        refs = materialize(self.refs.join(ids, "doc_id", "left_anti"))
        c = self.counts.join(gone, ["shard", "k1", "k2"], "left")
        c = materialize(c.withColumn("n_docs", F.col("n_docs") - F.coalesce("less", F.lit(0))))
        left = c.where("n_docs > 0")
        stays = F.col("gone_max").isNull() | (F.col("gone_max") < F.col("max_doc"))
        again = left.where(~stays).select("k1", "k2")
        recounted = self._summed(refs.join(again, ["k1", "k2"], "left_semi"))
        counts = materialize(left.where(stays).select(self.counts.columns).unionByName(recounted))
        was = self.settled()
        return replace(was, refs=refs, counts=counts, filters=was._changed(c.where("n_docs <= 0").select("shard", "k1"), _shrink, counts))

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Keys that lose lines, with the document that keeps its own."""
        return self.counts.where(F.col("n_docs") >= min_docs).select("k1", "k2", F.col("max_doc").alias("keeper"))

    def dropped(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """doc_id, row (the hash of its text) and the numbers of its lines that go."""
        hit = self.refs.join(self.repeated(min_docs), ["k1", "k2"]).where("doc_id <> keeper")
        return hit.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line")).alias("lines"))

    def apply(self, docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text of documents that are in the
        index, and ``rest``: a struct of the columns to carry along."""
        docs = with_rest(docs, id_col, text_col, carry).withColumn("row", F.xxhash64("text"))
        joined = docs.join(self.dropped(min_docs), ["doc_id", "row"], "left").select("doc_id", "text", "lines", "rest")
        out = arrow_map(joined, _drop_lines, f"doc_id long, n_lines long, n_dropped long, kept_text string, rest {rest_type(docs)}")
        return out if carry else out.drop("rest")


def index_documents(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
    """An index of all documents, filled in ``batches`` insertions dealt by a hash of the id."""
    _, size = text_size(docs, text_col)
    index = LineIndex.empty(docs.sparkSession, max(8, size // 100 // SHARD_KEYS + 1), min_chars)
    refs = materialize(index.references(docs, id_col, text_col))
    for k in range(batches):
        index = index.insert(refs=refs.where(bucket_of("doc_id", batches) == k))
    return replace(index, refs=refs)


def line_dedup(docs: DataFrame, batches: int = 2, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text (and rest)."""
    return index_documents(docs, batches, id_col, text_col, min_chars).apply(docs, min_docs, id_col, text_col, carry)
