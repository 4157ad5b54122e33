"""Operator 13: near-duplicate embeddings by an epsilon grid order join.

Two vectors are linked if their cosine is at least ``min_cosine``: their unit
vectors are then at most eps = sqrt(2 - 2 * min_cosine) apart.

1. Equal vectors (bit for bit) form a class, so copies meet the join once.
2. Principal axes of the unit vectors come from summed moments of all rows. A
   class's cell is its coordinates on the leading axes in steps of eps.
3. Classes are sorted by (cells, key) over all tasks and cut into blocks of equal
   length, so a full cell is just a longer interval. Each block has a bounding box
   on the leading axes, and of the length of what the other axes hold.
4. Sequence intervals of ``FAN`` ** level blocks are joined recursively from the
   top: a pair of intervals whose boxes are more than eps apart is skipped, any
   other is split into the pairs of its parts. Each level is a pair of joins.
5. Surviving block pairs are compared in tiles: groups of block pairs that share
   blocks. Products in float32 find what may be linked, products in float64 decide,
   and what lies within 1e-12 of the bound is added up in order, as a plain loop
   does. A tile returns links per class and a spanning forest, never pairs, so a
   group of near copies gives as many rows as it has members in each tile.
6. Components of the forests; classes pass both results on to their rows.

Linked with nothing, component their own vec_id: null or empty vectors, zero vectors,
vectors with null or non-finite components. Rows with null vec_id: linked with
nothing, null component, kept. Vectors of different lengths are never linked. Rows with
equal ids are vectors of their own (with the same vec_id). Equal vectors are linked. Columns
other than vec_id and embedding are ignored, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import contiguous_ids
from .components import components
from .util import materialize

MIN_COSINE = 0.95
#: leading axes that are cut into cells and boxes
AXES = 12
#: intervals that an interval of the level above consists of
FAN = 4
#: rows of a block, at most; and bytes of its vectors
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 18
#: blocks on each side of a tile
TILE = 16


def _decode(col, dim: np.ndarray) -> tuple[list, np.ndarray]:
    """Rows by dimension: (dimension, rows, float64 matrix) from vectors as bytes."""
    out = []
    for d in np.unique(dim):
        at = np.flatnonzero(dim == d)
        raw = b"".join(col[i] for i in at)
        out.append((int(d), at, np.frombuffer(raw, np.float64).reshape(len(at), int(d))))
    return out


def vector_rows(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec, key): the vector as float64 bytes and its MD5, null if it cannot be linked."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(1)
            sizes = np.asarray(col.value_lengths().fill_null(0), np.int64)
            flat = col.flatten()
            bad = np.asarray(flat.is_null()) if flat.null_count else np.zeros(len(flat), bool)
            x = np.array(flat.fill_null(0.0), np.float64)
            off = np.append(0, np.cumsum(sizes))
            bad |= ~np.isfinite(x)
            wrong = np.append(0, np.cumsum(bad))
            some = np.append(0, np.cumsum(x != 0))
            ok = (np.diff(wrong[off]) == 0) & (np.diff(some[off]) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[off[i]:off[i + 1]].tobytes() if ok[i] else None for i in range(len(ok))], pa.binary())], names=["vec_id", "vec"])

    got = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, vec binary")
    return got.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.md5("vec")))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(classes: DataFrame, dim: int, n_axes: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, leading axes as columns) of the unit vectors, shorter ones filled with
    zeros: one dim x dim partial sum per task, added up by rows of the matrix."""
    def run(batches):
        g = np.zeros((dim + 1, dim + 1))
        for b in batches:
            col = b.column(0).to_pylist()
            for d, at, x in _decode(col, np.array([len(v) // 8 for v in col])):
                u = np.column_stack([_unit(x), np.ones(len(x))])
                at = np.append(np.arange(d), dim)
                g[np.ix_(at, at)] += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(list(g), pa.list_(pa.float64()))], names=["i", "row"])

    parts = classes.select("vec").mapInArrow(run, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    got = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    g = np.zeros((dim + 1, dim + 1))
    g[got["i"], got["j"]] = got["x"]
    n = max(g[dim, dim], 1.0)
    mean = g[:dim, dim] / n
    _, axes = np.linalg.eigh(g[:dim, :dim] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1][:, :n_axes]


def _blocks(classes: DataFrame, mean: np.ndarray, axes: np.ndarray, eps: float, rows: int) -> tuple[DataFrame, DataFrame]:
    """((block, pos, n, vecs, lo, hi), (key, pos, n)): classes in grid order, cut into blocks."""
    k = axes.shape[1]

    def cells(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(1).to_pylist()
            at = np.zeros((len(col), k))
            rest = np.zeros(len(col))
            for d, i, x in _decode(col, np.array([len(v) // 8 for v in col])):
                u = _unit(x) - mean[:d]
                at[i] = u @ axes[:d] - mean[d:] @ axes[d:]
                rest[i] = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", u, u) + mean[d:] @ mean[d:] - np.einsum("ij,ij->i", at[i], at[i])))
            cell = np.floor(at / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(cell), pa.list_(pa.int32())), pa.array(list(np.column_stack([at, rest])), pa.list_(pa.float64()))],
                                             names=["key", "vec", "n", "cell", "at"])

    placed = classes.mapInArrow(cells, "key string, vec binary, n long, cell array<int>, at array<double>")
    placed = materialize(contiguous_ids(placed.orderBy("cell", "key").select("key", "vec", "n", "at"), "pos"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        at = np.array(table["at"].to_pylist())
        vec = table["vec"].to_pylist()
        dim = np.array([len(v) // 8 for v in vec], np.int64)
        lens = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({"block": [table["block"][0].as_py()], "pos": lens(table["pos"].to_numpy()), "n": lens(table["n"].to_numpy()), "dim": lens(dim),
                         "vecs": pa.array([b"".join(vec)], pa.binary()), "lo": pa.array([at.min(0)], pa.list_(pa.float64())), "hi": pa.array([at.max(0)], pa.list_(pa.float64()))})

    dealt = placed.withColumn("block", F.floor(F.col("pos") / rows).cast("long"))
    packed = dealt.groupBy("block").applyInArrow(pack, "block long, pos binary, n binary, dim binary, vecs binary, lo array<double>, hi array<double>")
    return materialize(packed), placed.select("key", "pos", "n")


def _near(eps: float):
    """Whether two boxes (alo, ahi), (blo, bhi) may hold points eps apart."""
    gap = F.zip_with(F.zip_with("alo", "bhi", lambda x, y: x - y), F.zip_with("blo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= F.lit(eps * eps * (1 + 1e-9) + 1e-12)


def block_pairs(boxes: DataFrame, n_blocks: int, eps: float, fan: int = FAN) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose boxes are at most eps apart, found by
    splitting pairs of sequence intervals level by level. ``boxes(block, lo, hi)``."""
    height = 0
    while fan ** height < n_blocks:
        height += 1
    level = boxes.select(F.col("block").alias("i"), "lo", "hi")
    levels = [level]
    k = len(boxes.select("lo").first()["lo"])
    for _ in range(height):
        up = level.groupBy(F.floor(F.col("i") / fan).cast("long").alias("i")).agg(
            *[F.min(F.col("lo")[j]).alias(f"l{j}") for j in range(k)], *[F.max(F.col("hi")[j]).alias(f"h{j}") for j in range(k)])
        level = materialize(up.select("i", F.array(*[f"l{j}" for j in range(k)]).alias("lo"), F.array(*[f"h{j}" for j in range(k)]).alias("hi")))
        levels.append(level)
    pairs = levels[-1].select(F.col("i").alias("a"), F.col("i").alias("b"))
    parts = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + fan - 1))
    for level in reversed(levels[:-1]):
        split = pairs.withColumn("a2", parts("a")).withColumn("b2", parts("b")).where("a2 <= b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        split = (split.join(level.select(F.col("i").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi")), "a")
                 .join(level.select(F.col("i").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi")), "b"))
        pairs = materialize(split.where(_near(eps)).select("a", "b"))
    return pairs


def _linked(x: np.ndarray, y: np.ndarray, u32: np.ndarray, v32: np.ndarray, u: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with a cosine of at least ``least``."""
    s = u32 @ v32.T
    i, j = np.nonzero(s >= least - 1e-5 * math.sqrt(max(u.shape[1], 64) / 64))
    if not len(i):
        return i, j
    if len(i) * 8 > s.size:
        c = (u @ v.T)[i, j]
    else:
        c = np.concatenate([np.einsum("ij,ij->i", u[i[k:k + 65536]], v[j[k:k + 65536]]) for k in range(0, len(i), 65536)])
    ok = c >= least
    for p in np.flatnonzero(np.abs(c - least) < 1e-12):
        a, b = x[i[p]].tolist(), y[j[p]].tolist()
        dot = na = nb = 0.0
        for s1, s2 in zip(a, b):
            dot, na, nb = dot + s1 * s2, na + s1 * s1, nb + s2 * s2
        bound = na * nb
        ok[p] = dot / math.sqrt(bound) >= least if 0 < bound < math.inf else bool(c[p] >= least)
    return i[ok], j[ok]


def _smallest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining items i and j (labels point at the smallest item)."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _compare(least: float):
    """A tile: blocks with the blocks each is compared with, to (pos, links, root)."""
    def run(table: pa.Table) -> pa.Table:
        blocks, start, pairs = {}, 0, []
        pos_all = []
        for r in table.select(["block", "with", "pos", "n", "dim", "vecs"]).to_pylist():
            pos, n, dim = (np.frombuffer(r[c], np.int64) for c in ("pos", "n", "dim"))
            cuts = np.append(0, np.cumsum(dim * 8))
            parts = []
            for d, at, x in _decode([r["vecs"][p:q] for p, q in zip(cuts[:-1], cuts[1:])], dim):
                u = _unit(x)
                parts.append((d, at + start, x, u, u.astype(np.float32), n[at]))
            blocks[r["block"]] = parts
            pairs += [(r["block"], b) for b in r["with"]]
            pos_all.append(pos)
            start += len(pos)
        links, label = np.zeros(start, np.int64), np.arange(start)
        for a, b in pairs:
            for d, at, x, u, u32, n in blocks[a]:
                for d2, at2, y, v, v32, n2 in blocks[b]:
                    if d != d2:
                        continue
                    i, j = _linked(x, y, u32, v32, u, v, least)
                    if a == b:
                        i, j = i[i < j], j[i < j]
                    if not len(i):
                        continue
                    links[at] += np.bincount(i, weights=n2[j], minlength=len(at)).astype(np.int64)
                    links[at2] += np.bincount(j, weights=n[i], minlength=len(at2)).astype(np.int64)
                    label = _smallest(start, at[i], at2[j], label)
        pos = np.concatenate(pos_all)
        some = np.flatnonzero(links)
        return pa.table({"pos": pos[some], "links": links[some], "root": pos[label[some]]})
    return run


def near_vectors(rows: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id", vec_col: str = "embedding", axes: int = AXES,
                 block_rows: int = BLOCK_ROWS, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row; 0 < min_cosine < 1."""
    if not 0 < min_cosine < 1:
        raise ValueError("min_cosine lies between 0 and 1")
    eps = math.sqrt(2 - 2 * min_cosine)
    vecs = materialize(vector_rows(rows, id_col, vec_col))
    classes = materialize(vecs.where("key is not null").groupBy("key", "vec").agg(F.count(F.lit(1)).alias("n")))
    alone = vecs.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    got = classes.agg(F.max(F.octet_length("vec")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not got["n"]:
        return alone
    dim = got["b"] // 8
    size = max(16, min(block_rows, BLOCK_BYTES // got["b"]))
    mean, leading = principal_axes(classes, dim, min(axes, dim))
    blocks, placed = _blocks(classes, mean, leading, eps, size)
    pairs = block_pairs(blocks.select("block", "lo", "hi"), -(-got["n"] // size), eps, fan)
    tiles = pairs.select(F.floor(F.col("a") / tile).alias("ta"), F.floor(F.col("b") / tile).alias("tb"), "a", "b")
    # each block of a tile once, with the blocks that it is to be compared with
    ends = tiles.select("ta", "tb", F.col("a").alias("block"), F.col("b").alias("other")).unionByName(
        tiles.select("ta", "tb", F.col("b").alias("block"), F.lit(None).cast("long").alias("other")))
    sides = ends.groupBy("ta", "tb", "block").agg(F.collect_list("other").alias("with")).join(blocks.drop("lo", "hi"), "block")
    found = materialize(sides.groupBy("ta", "tb").applyInArrow(_compare(min_cosine), "pos long, links long, root long"))
    links = found.groupBy("pos").agg(F.sum("links").alias("links"))
    comp = components(found.where("pos <> root").select(F.col("pos").alias("u"), F.col("root").alias("v")))
    of = placed.join(links, "pos", "left").join(comp.withColumnRenamed("node", "pos"), "pos", "left")
    of = of.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "pos").alias("component"))
    every = materialize(vecs.where("key is not null").select("vec_id", "key").join(of, "key").select("vec_id", "n_links", "component"))
    least = every.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return (every.join(least, "component").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
            .unionByName(alone))
