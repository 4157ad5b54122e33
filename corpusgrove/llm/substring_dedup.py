"""Operator 1: exact substring dedup with a count-min prefilter.

A window is ``window`` consecutive words of one document. A window is a repeat
if its word sequence also starts in a document with a smaller id, and every
word that a repeat covers is removed.

1. Documents are dealt into blocks by a hash of their id. Each block counts its
   distinct windows (a window once per document, saturating at two) in a
   count-min sketch of ``depth`` rows. The width follows the size of the
   corpus. Only counters that are not zero leave the block, as compressed gaps.
2. Each range of counters is summed over all blocks in a dense array. The answer
   to a block is one bit per counter it sent: is the merged count at least two?
   A count-min sum is never too small, so no repeated window is missed.
3. Blocks compute their windows again. Only windows whose counters are all
   repeated go on, as 96-bit hashes with the smallest document of the block.
   The groups of equal hashes are exact (two independent polynomial hashes; a
   false match would need both to collide). The answer to a block is again one
   bit per window: does a smaller document of another block have it?
4. Each block marks its repeats and rebuilds the texts.

Documents and answers meet by block (cogroup). No broadcast, nothing on the
driver but two sums, and a window that a third of all documents share leaves
each block once.

Null text: no words. Empty table: empty result. Repeated ids: rows are judged
one by one, and an equal id is not a smaller one. Null ids are never smaller
than another and find no smaller one, so their text is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .util import arrow_map, bucket_of, materialize, shuffle_partitions, text_size

WINDOW = 50
DEPTH = 2
BLOCK_BYTES = 4 << 20
#: counters of the sketch that one task sums
RANGE_BITS = 23
#: distinct windows estimated repeated that one task groups, about
EXACT_PER_TASK = 2_000_000
_ROW_MUL = (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)

_SKETCH = "row int, part int, block int, n int, wide boolean, gaps binary, twice binary"
_ANSWER = "block int, kind int, row int, part int, n int, flags binary"
_EXACT = "part int, block int, n int, h1 binary, h2 binary, doc binary, ids binary"
NO_ID = np.iinfo(np.int64).max


class _Windows:
    """The windows of a block in a fixed order: documents by id."""

    def __init__(self, table: pa.Table, window: int, second: bool):
        ids = table.column("doc_id").combine_chunks()
        self.null_id = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(NO_ID)).astype(np.int64)
        self.col = table.column("text").combine_chunks()
        h1, h2, row, self.first, pos = [], [], [], [0], []
        self.parts = []
        buf, off = T.flat(self.col)
        base = 0
        for i, j in T.slices(off):
            b, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
            starts, ends, first = T.words(b, o)
            ok = np.flatnonzero(T.window_mask(first, window))
            if len(ok):
                w = T.span_hash(b, starts, ends)
                h1.append(T.window_hash(w, window)[ok])
                row.append((T.owner(first)[ok] + i).astype(np.int32))
                pos.append(ok + base)
                if second:
                    h2.append((T.window_hash(T.span_hash(b, starts, ends, 1), window, 1)[ok] >> np.uint64(32)).astype(np.uint32))
            self.first.extend((first[1:] + base).tolist())
            base += int(first[-1])
        cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
        self.h1, self.row, self.pos = cat(h1, np.uint64), cat(row, np.int32), cat(pos, np.int64)
        self.h2 = cat(h2, np.uint32)
        self.n_words = base

    def counters(self, row: int, width: int) -> np.ndarray:
        return (self.h1 * np.uint64(_ROW_MUL[row])) >> np.uint64(64 - width)


def _sorted_block(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending")]) if table.num_rows > 1 else table


def _sketch(window: int, width: int, depth: int):
    part_bits = min(RANGE_BITS, width)

    def run(key, table):
        block = key[0].as_py()
        w = _Windows(_sorted_block(table), window, False)
        out: dict[str, list] = {k.split()[0]: [] for k in _SKETCH.split(", ")}
        # a window counts once per document, and two documents are enough
        order = np.argsort(w.h1, kind="stable")
        h, ids = w.h1[order], w.ids[w.row[order]]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        many = ids[at] != ids[np.append(at[1:], len(h)) - 1] if len(at) else np.zeros(0, bool)
        h = h[at]
        for r in range(depth if len(h) else 0):
            c = (h * np.uint64(_ROW_MUL[r])) >> np.uint64(64 - width)
            o = np.argsort(c)
            c, m = c[o], many[o]
            keep = np.ones(len(c), bool)
            keep[1:] = c[1:] != c[:-1]
            at = np.flatnonzero(keep)
            size = np.diff(np.append(at, len(c)))
            twice = np.logical_or.reduceat(m, at) | (size > 1)
            c = c[at]
            part = (c >> np.uint64(part_bits)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, z in zip(cut, np.append(cut[1:], len(c))):
                rel = (c[a:z] & np.uint64((1 << part_bits) - 1)).astype(np.int64)
                gaps = np.diff(rel, prepend=0)
                wide = bool(gaps.max() > 0xFFFF)
                for k, v in zip(out, (r, int(part[a]), block, int(z - a), wide, T.squeeze(gaps.astype(np.uint32 if wide else np.uint16)), T.bits(twice[a:z]))):
                    out[k].append(v)
        return _table(out, _SKETCH)
    return run


def _table(cols: dict[str, list], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return pa.table({n: pa.array(cols[n], kinds[k]) for n, k in (f.split() for f in schema.split(", "))})


def _sum_sketches(width: int):
    part_bits = min(RANGE_BITS, width)

    def run(key, table):
        rows = table.to_pylist()
        count = np.zeros(1 << part_bits, np.uint8)
        at = []
        for x in rows:
            rel = np.cumsum(T.unsqueeze(x["gaps"], np.uint32 if x["wide"] else np.uint16, x["n"]).astype(np.int64))
            at.append(rel.astype(np.int32))
            # counters of one block are distinct, so this adds each of them once; two is enough
            count[rel] = np.minimum(count[rel] + 1 + T.unbits(x["twice"], x["n"]), 2)
        flags = [T.bits(count[rel] >= 2) for rel in at]
        return _table({"block": [x["block"] for x in rows], "kind": [0] * len(rows), "row": [x["row"] for x in rows], "part": [x["part"] for x in rows], "n": [x["n"] for x in rows], "flags": flags}, _ANSWER)
    return run


def _suspects(w: _Windows, answers: pa.Table, width: int, depth: int) -> np.ndarray:
    """Windows all of whose merged counters are at least two."""
    mask = np.ones(len(w.h1), bool)
    rows = sorted((x for x in answers.to_pylist() if x["kind"] == 0), key=lambda x: (x["row"], x["part"]))
    for r in range(depth if len(w.h1) else 0):
        c = w.counters(r, width)
        mine, inverse = np.unique(c, return_inverse=True)
        flags = np.concatenate([T.unbits(x["flags"], x["n"]) for x in rows if x["row"] == r])
        if len(flags) != len(mine):
            raise ValueError("the answer does not belong to this block")
        mask &= flags[inverse]
    return np.flatnonzero(mask)


def _distinct(w: _Windows, at: np.ndarray):
    """Distinct suspected windows of the block in hash order: (h1, h2, smallest
    row, group of each suspect)."""
    order = np.lexsort((w.row[at], w.h2[at], w.h1[at]))
    at = at[order]
    new = np.ones(len(at), bool)
    new[1:] = (w.h1[at[1:]] != w.h1[at[:-1]]) | (w.h2[at[1:]] != w.h2[at[:-1]])
    lead = at[new]
    return w.h1[lead], w.h2[lead], w.row[lead], at, np.cumsum(new) - 1


def _candidates(window: int, width: int, depth: int, parts: int):
    shift = np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else None

    def run(key, docs, answers):
        out: dict[str, list] = {k.split()[0]: [] for k in _EXACT.split(", ")}
        if docs.num_rows:
            w = _Windows(_sorted_block(docs), window, True)
            h1, h2, row, _, _ = _distinct(w, _suspects(w, answers, width, depth))
            if len(h1):
                part = (h1 >> shift).astype(np.int64) if shift is not None else np.zeros(len(h1), np.int64)
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for a, z in zip(cut, np.append(cut[1:], len(h1))):
                    used, doc = np.unique(row[a:z], return_inverse=True)
                    for k, v in zip(out, (int(part[a]), key[0].as_py(), int(z - a), h1[a:z].tobytes(), h2[a:z].tobytes(), T.squeeze(doc.astype(np.uint32)), w.ids[used].tobytes())):
                        out[k].append(v)
        return _table(out, _EXACT)
    return run


def _group_exactly(key, table):
    """Per block and window: has another block a smaller document with it?"""
    rows = table.to_pylist()
    h1 = np.concatenate([np.frombuffer(x["h1"], np.uint64) for x in rows])
    h2 = np.concatenate([np.frombuffer(x["h2"], np.uint32) for x in rows])
    doc = np.concatenate([np.frombuffer(x["ids"], np.int64)[T.unsqueeze(x["doc"], np.uint32, x["n"])] for x in rows])
    order = np.lexsort((doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smallest = d[new][np.cumsum(new) - 1]
    earlier = np.zeros(len(a), bool)
    earlier[order] = smallest < d
    ends = np.cumsum([x["n"] for x in rows])
    return _table({"block": [x["block"] for x in rows], "kind": [1] * len(rows), "row": [0] * len(rows), "part": [x["part"] for x in rows], "n": [x["n"] for x in rows], "flags": [T.bits(earlier[e - x["n"]:e]) for x, e in zip(rows, ends)]}, _ANSWER)


def _rebuild(window: int, width: int, depth: int):
    def run(key, docs, answers):
        docs = _sorted_block(docs)
        w = _Windows(docs, window, True)
        gone = np.zeros(w.n_words + 1, np.int32)
        if len(w.h1):
            h1, h2, row, at, group = _distinct(w, _suspects(w, answers, width, depth))
            if len(h1):
                flags = [x for x in sorted(answers.to_pylist(), key=lambda x: x["part"]) if x["kind"] == 1]
                earlier = np.concatenate([T.unbits(x["flags"], x["n"]) for x in flags])
                if len(earlier) != len(h1):
                    raise ValueError("the answer does not belong to this block")
                repeat = (earlier[group] | (w.ids[w.row[at]] > w.ids[row[group]])) & ~w.null_id[w.row[at]]
                start = w.pos[at[repeat]]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
        covered = np.cumsum(gone[:-1]) > 0
        first = np.asarray(w.first)
        n_words = np.diff(first)
        c = np.concatenate([[0], np.cumsum(covered)])
        n_removed = c[first[1:]] - c[first[:-1]]
        kept = []
        buf, off = T.flat(w.col)
        for i, j in T.slices(off):
            kept.append(_joined(buf[off[i]:off[j]], off[i:j + 1] - off[i], ~covered[first[i]:first[j]]))
        text = pa.chunked_array(kept, pa.string()) if kept else pa.chunked_array([], pa.string())
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": text})
    return run


_RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _joined(b: np.ndarray, o: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Kept words of each row, joined by one space."""
    starts, ends, first = T.words(b, o)
    row = T.owner(first)
    starts, ends, row = starts[keep], ends[keep], row[keep]
    if not len(starts):
        return pa.array([""] * (len(o) - 1), pa.string())
    edge = np.zeros(len(b) + 2, np.int8)
    edge[starts] = 1
    edge[ends] -= 1  # a word may start where none ends: words are apart by a separator or a row
    inside = np.cumsum(edge[:-2], dtype=np.int8).astype(bool)
    inside[starts] = True
    out = b.copy()
    between = np.append(row[1:] == row[:-1], False)
    inside[ends[between]] = True
    out[ends[between]] = 0x20
    size = np.concatenate([[0], np.cumsum(inside)])
    off = size[o].astype(np.int32)
    return pa.StringArray.from_buffers(len(o) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(out[inside].tobytes()))


def _whole(b: pa.RecordBatch):
    """Rows without an id are neither earlier nor later than any: they keep all words, in no block."""
    buf, off = T.flat(b.column(1))
    for i, j in T.slices(off):
        x, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        first = T.words(x, o)[2]
        n_words = np.diff(first)
        yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(np.zeros(j - i, np.int64)),
                                          _joined(x, o, np.ones(int(first[-1]), bool))], names=["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text."""
    if not 1 <= depth <= len(_ROW_MUL):
        raise ValueError(f"depth must be 1 to {len(_ROW_MUL)}")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, size = text_size(docs)
    blocks = max(1, min(n, max(-(-size // BLOCK_BYTES), shuffle_partitions(spark))))
    width = max(16, min(56, int(size * 4 // 5).bit_length()))
    parts = max(1, min(1 << 20, size // 20 // EXACT_PER_TASK + 1))
    dealt = docs.where("doc_id is not null").withColumn("block", bucket_of("doc_id", blocks))
    sketch = dealt.groupBy("block").applyInArrow(_sketch(window, width, depth), _SKETCH)
    answers = materialize(sketch.groupBy("row", "part").applyInArrow(_sum_sketches(width), _ANSWER))
    by_block = dealt.groupBy("block")
    exact = by_block.cogroup(answers.groupBy("block")).applyInArrow(_candidates(window, width, depth, parts), _EXACT)
    earlier = exact.groupBy("part").applyInArrow(_group_exactly, _ANSWER)
    with_id = by_block.cogroup(answers.unionByName(earlier).groupBy("block")).applyInArrow(_rebuild(window, width, depth), _RESULT)
    return with_id.unionByName(arrow_map(docs.where("doc_id is null"), _whole, _RESULT))
