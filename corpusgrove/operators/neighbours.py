"""k-nearest-neighbour graph (D10), exact, without all-pairs, for any metric with a
triangle inequality; and an approximate graph.

1. **Cell tree.** Centres are points drawn by a hash of their vector (so copies count
   once): about ``n / cell_size`` leaf centres, every ``FAN``-th of them for the
   level above, up to one root. Points and lower centres descend by joins: a row
   meets only the children of the node that it has reached. Each node keeps
   its radius, the greatest distance of a point below it. No list of all centres
   exists on the driver or in a task. A leaf cell with more than ``cell_size`` points is
   split into sub-cells by a hash of the row id, so no task holds more than
   ``cell_size`` candidates however skewed the data is.
2. **First pass.** Every point is a query in its own sub-cell; each
   (cell, sub-cell) group runs a NumPy brute force in ``applyInPandas``
   (at most ``cell_size`` x ``cell_size`` distances per task).
3. **Exact refinement.** With ``r`` the current k-th distance of a query, a node with
   centre c and radius R can only hold a closer point if ``d(q, c) - R < r``
   (triangle inequality). Queries walk down the tree again, by joins, into
   all nodes within that bound, and meet the sub-cells not searched yet. The result
   equals brute force; the work is what the bound cannot prune.

In many dimensions the bound prunes little, and a row for each query and cell would
be more data than any disk holds. So with more than ``WALK_PAIRS`` such pairs, steps 2
and 3 work on blocks: points and queries, in the order of the tree, are dealt to blocks of equal
length (``_dealt``), whatever the sizes of the cells. A query block first meets the candidate
block with the nearest centre, then those that the bounds of all its queries leave, so a
row travels once per block of the other side. A task holds two blocks, of ``BLOCK_ROWS``
rows and ``BLOCK_NUMBERS`` numbers at most.

In a task, candidates and queries are cut into tiles by medians, and the bound is applied
again, for each query and tile. Euclidean distances are screened by a matrix
product with an error bound, manhattan and chebyshev ones in single precision; what is within it
is computed by differences.

Metrics: those of :data:`DIRECT` as they are; sqeuclidean as e * e of the euclidean
distance e; cosine and correlation as e * e / 2 of unit vectors; seuclidean, mahalanobis and
wminkowski on scaled or whitened vectors. Others have no triangle inequality and
are refused with :class:`MetricError`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.materialize import materialize
from .ids import contiguous_ids

EDGE_SCHEMA = "row_id long, nbr long, d double"

#: rows of a query block that meets the candidates of a sub-cell at once
QUERY_BLOCK = 1024
#: queries that one task searches in one sub-cell, about
QUERIES_PER_TASK = 16384
#: pairs of a query and a cell up to which each query walks down the tree by itself
WALK_PAIRS = 1 << 18
#: the most rows, and numbers, in a block of points or queries
BLOCK_ROWS = 1 << 15
BLOCK_NUMBERS = 1 << 21
#: numbers that block pairs are sent at once (8 bytes each)
MEET_NUMBERS = 1 << 28
#: blocks that the rows are dealt to, unless these would be smaller than a cell
MIN_BLOCKS = 8
#: candidates of a task that are compared at once
TILE = 1024
#: lengths between which single precision screens euclidean distances
SINGLE = (1e-12, 1e12)
#: pairs whose exact distances are computed at once
PAIRS_AT_ONCE = 1 << 14
#: distances in single precision that are summed at once
CACHED = 1 << 17
#: children of a tree node, on average
FAN = 64
#: tasks that the rows of a tree node, and of the whole top, are dealt to at least
NODE_TASKS = 8
TOP_TASKS = 64
#: metrics with a triangle inequality that are computed on the given vectors
DIRECT = ("euclidean", "manhattan", "chebyshev", "minkowski", "canberra", "haversine")


class MetricError(ValueError):
    """The metric cannot bound distances (no triangle inequality)."""


@dataclass(frozen=True)
class Metric:
    """A metric by name, with its fitted parameters (``p``, ``w``, ``V``, ``VI``)."""
    name: str = "euclidean"
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.base not in DIRECT:
            raise MetricError(f"{self.name!r} has no triangle inequality that neighbours could be found by")
        if self.base == "minkowski" and self.p < 1:
            raise MetricError("minkowski needs p >= 1")

    @property
    def base(self) -> str:
        return {"l1": "manhattan", "sqeuclidean": "euclidean", "cosine": "euclidean", "correlation": "euclidean", "seuclidean": "euclidean", "mahalanobis": "euclidean", "wminkowski": "minkowski"}.get(self.name, self.name)

    @property
    def p(self) -> float:
        return float(self.params.get("p", 2.0))

    def prepared(self, vec: str) -> Column:
        """The vector that the base metric is computed on."""
        v = V.as_double(vec)
        if self.name in ("cosine", "correlation"):
            v = V.center(v) if self.name == "correlation" else v
            n = V.norm(v)
            # a zero vector gets a dimension of its own: at distance 1 of all others, at 0 of zeros
            return F.when(n > 0, F.concat(F.transform(v, lambda x: x / n), F.array(F.lit(0.0)))).otherwise(F.concat(F.transform(v, lambda x: F.lit(0.0)), F.array(F.lit(1.0))))
        if self.name == "wminkowski":
            return V.scale(v, self.params["w"])
        if self.name == "seuclidean":
            return V.scale(v, [1.0 / math.sqrt(x) if x > 0 else 0.0 for x in self.params["V"]])
        if self.name == "mahalanobis":
            return V.whiten(v, self.params["VI"])
        return v

    def between(self, a, b) -> Column:
        return V.distance(a, b, self.base, **({"p": self.p} if self.base == "minkowski" else {}))

    def reported(self, d: Column) -> Column:
        return d * d / 2 if self.name in ("cosine", "correlation") else d * d if self.name == "sqeuclidean" else d

    def pairwise(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Base distances of all rows of q and c, one dimension at a time
        (differences, not the Gram form: equal points are at distance 0)."""
        return self._distances(lambda f, j: f.outer(q[:, j], c[:, j]), (len(q), len(c)), c.shape[1])

    def paired(self, q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Base distances of the vectors at i of q and at j of c in pairs, as in :meth:`pairwise`;
        q and c have a row per dimension."""
        return self._distances(lambda f, x: f(q[x][i], c[x][j]), len(i), len(c))

    def _distances(self, of, shape, dim: int) -> np.ndarray:
        if self.base == "haversine":
            lat = np.sin(of(np.subtract, 0) / 2) ** 2
            lon = np.sin(of(np.subtract, 1) / 2) ** 2
            return 2 * np.arcsin(np.sqrt(np.minimum(1.0, lat + of(_cosines, 0) * lon)))
        out = np.zeros(shape)
        for j in range(dim):
            d = of(np.subtract, j)
            if self.base == "euclidean":
                out += np.multiply(d, d, out=d)
                continue
            np.abs(d, out=d)
            if self.base == "manhattan":
                out += d
            elif self.base == "chebyshev":
                np.maximum(out, d, out=out)
            elif self.base == "minkowski":
                out += d ** self.p
            else:
                both = of(_sizes, j)
                out += np.divide(d, both, out=np.zeros_like(d), where=both > 0)
        if self.base == "euclidean":
            return np.sqrt(out, out=out)
        return out ** (1.0 / self.p) if self.base == "minkowski" else out

    def screened(self, q: np.ndarray, c: np.ndarray):
        """(x, base, slack): x + base[:, None] orders as the distances of all rows do, and is that
        of the distance squared (euclidean) or the distance, to within slack[:, None]."""
        if self.base in ("manhattan", "chebyshev"):
            return self._single(q, c)
        if self.base != "euclidean":
            return self.pairwise(q, c), np.zeros(len(q)), np.zeros(len(q))
        mid = c.mean(axis=0)
        q, c = q - mid, c - mid
        q2, c2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
        x = q @ (-2.0 * c).T
        x += c2
        return x, q2, 4e-15 * (c.shape[1] + 8) * (q2 + c2.max())

    def _single(self, q: np.ndarray, c: np.ndarray):
        """As :meth:`screened`, in single precision, a few queries at a time: what they need stays in cache."""
        far, join = (np.sum, np.add) if self.base == "manhattan" else (np.max, np.maximum)
        mid = c.mean(axis=0)
        left, right = q - mid, c - mid
        qn, cn = far(np.abs(left), axis=1), far(np.abs(right), axis=1)
        if not SINGLE[0] < max(qn.max(), cn.max()) < SINGLE[1]:
            return self.pairwise(q, c), np.zeros(len(q)), np.zeros(len(q))
        slack = 1.2e-7 * (c.shape[1] + 8) * (qn + cn.max())
        left, right = (np.ascontiguousarray(v.T, np.float32) for v in (left, right))
        out = np.zeros((len(q), len(c)), np.float32)
        hop = max(1, CACHED // len(c))
        for i in range(0, len(q), hop):
            at = out[i:i + hop]
            d = np.empty_like(at)
            for a, b in zip(left[:, i:i + hop], right):
                np.subtract(a[:, None], b, out=d)
                join(at, np.abs(d, out=d), out=at)
        return out, np.zeros(len(q)), slack

    def within(self, q: np.ndarray, c: np.ndarray, most: np.ndarray) -> np.ndarray | None:
        """Places (in the raveled matrix) of all pairs whose distance squared is at most ``most`` of
        their query, and of a few farther ones: one product in single precision, with an error
        bound. None if that cannot tell (another metric, no bound, lengths out of range)."""
        if self.base != "euclidean" or not np.isfinite(most).all():
            return None
        mid = c.mean(axis=0)
        q, c = q - mid, c - mid
        q2, c2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", c, c)
        longest = max(q2.max(), c2.max(), most.max())
        if not SINGLE[0] < longest < SINGLE[1]:
            return None
        slack = 2.5e-7 * (c.shape[1] + 8) * (q2 + c2.max() + most)
        left = np.column_stack([-2.0 * q, np.ones(len(q)), q2 - most - slack]).astype(np.float32)
        right = np.column_stack([c, c2, np.ones(len(c))]).astype(np.float32)
        return np.flatnonzero((left @ right.T <= 0).ravel())


class _Outer:
    """A function of two columns that also has the outer form."""

    def __init__(self, one, join):
        self.one, self.join = one, join

    def __call__(self, a, b):
        return self.join(self.one(a), self.one(b))

    def outer(self, a, b):
        return self.join.outer(self.one(a), self.one(b))


_cosines, _sizes = _Outer(np.cos, np.multiply), _Outer(np.abs, np.add)


@dataclass(frozen=True)
class PointIndex:
    """Points by cell (row_id, _v, cell, sub, way), and the tree: per level (node, kids) with
    kids of (id, c, r, nsub). Without levels there is one cell of ``nsub`` sub-cells.
    ``way`` are the nodes that lead to the cell."""
    cells: DataFrame
    levels: list[DataFrame]
    nsub: int
    metric: Metric
    n: int
    cell_size: int

    def walks(self, n_queries: int) -> bool:
        """Whether that many queries are few enough to walk each by itself."""
        return n_queries * max(1, math.ceil(self.n / self.cell_size)) <= WALK_PAIRS

    @cached_property
    def dealt(self) -> DataFrame:
        """The points (row_id, _v, pos, block) in the order of the tree."""
        return _dealt(self.cells.select("row_id", "_v", "way"), ["way", "row_id"], self.cell_size, self.cells)


def _dealt(rows: DataFrame, by: list[str], least: int, beside: DataFrame | None = None) -> DataFrame:
    """``rows`` with a place (pos) in the order of ``by``, without it, and a block: runs of equal length."""
    placed = contiguous_ids(rows.orderBy(*by), "_place").drop(*[c for c in by if c != "row_id"]).withColumnRenamed("_place", "pos")
    n, dim = placed.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    size = min(max(math.ceil(n / MIN_BLOCKS), least), BLOCK_ROWS, max(1, BLOCK_NUMBERS // max(dim or 1, 1)))
    return materialize(placed.withColumn("block", F.floor(F.col("pos") / F.lit(size))), beside)


def _outline(rows: DataFrame, metric: Metric, bound: Column) -> DataFrame:
    """(block, c, rad, r): centre and radius of each block, and the greatest bound in it."""
    mid = rows.groupBy("block").agg(V.mean_vector("_v", V.vector_dim(rows, "_v")).alias("c"))
    far = rows.join(F.broadcast(mid), "block").select("block", "c", metric.between("_v", "c").alias("d"), bound.alias("r"))
    return materialize(far.groupBy("block").agg(F.first("c").alias("c"), F.max("d").alias("rad"), F.max("r").alias("r")))


def _meet(cand: DataFrame, queries: DataFrame, pairs: DataFrame, run) -> DataFrame:
    """Queries (by ``block``) against the candidates of the blocks that ``pairs(qb, cb)`` name."""
    n = pairs.count()
    q = queries.withColumnRenamed("block", "qb").join(F.broadcast(pairs), "qb").withColumn("_role", F.lit(0))
    c = cand.withColumnRenamed("block", "cb").join(F.broadcast(pairs), "cb").withColumn("_role", F.lit(1))
    for name, kind in q.dtypes:
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    both = q.unionByName(c.select(*q.columns))
    return both.repartition(min(max(3 * n, 1), 2048), "qb", "cb").groupBy("qb", "cb").applyInPandas(run, EDGE_SCHEMA)


def _in_blocks(index: PointIndex, cand: DataFrame, queries: DataFrame, run, k: int, alpha: float = 1.0) -> DataFrame:
    """Edges that hold the k best of each query within its ``_bound``. ``cand`` and
    ``queries`` have (row_id, _v, block) and what ``run`` needs."""
    there = _outline(cand, index.metric, F.lit(0.0)).select(F.col("block").alias("cb"), F.col("c").alias("cc"), F.col("rad").alias("crad"))

    def pairs(q):
        at = _outline(q, index.metric, F.col("_bound")).select(F.col("block").alias("qb"), "c", "rad", "r")
        return at.crossJoin(F.broadcast(there)).withColumn("apart", index.metric.between("c", "cc"))

    nearest = F.row_number().over(Window.partitionBy("qb").orderBy("apart", "cb"))
    own = materialize(pairs(queries).withColumn("i", nearest).where("i = 1").select("qb", "cb"))
    first = materialize(_meet(cand, queries, own, run))
    kth = _merge(first, k).where(F.size("top") >= k).select("row_id", F.col("top")[k - 1]["d"].alias("_kth"))
    left = materialize(queries.join(kth, "row_id", "left").withColumn("_bound", F.least("_bound", F.coalesce("_kth", F.lit(float("inf"))))).drop("_kth"))
    reach = F.col("r") * F.lit(alpha) * (1 + 1e-9) + 1e-12
    gap = F.col("apart") - F.col("rad") - F.col("crad")
    rest = pairs(left).where((gap <= reach) | F.isnan(gap)).select("qb", "cb")
    rest = materialize(rest.join(own, ["qb", "cb"], "left_anti"))
    waves = _waves(rest, math.ceil(index.n / max(there.count(), 1)) * (V.vector_dim(cand, "_v") + 4))
    if len(waves) < 2:
        return first.unionByName(_meet(cand, left, rest, run))
    for low, high in waves:
        some = rest.where(F.col("qb").between(low, high))
        first = first.unionByName(materialize(_meet(cand, left.where(F.col("block").between(low, high)), some, run)))
    return first


def _waves(pairs: DataFrame, numbers: int) -> list[tuple[int, int]]:
    """Ranges of query blocks (one row each reaches the driver) whose ``pairs`` send at most
    ``MEET_NUMBERS`` at a time, with so many numbers in a block; their shuffles are on disk one after another."""
    out, held = [], 0
    for r in pairs.groupBy("qb").count().orderBy("qb").collect():
        size = 2 * numbers * r["count"]
        if out and held + size <= MEET_NUMBERS:
            out[-1] = (out[-1][0], r["qb"])
            held += size
        else:
            out.append((r["qb"], r["qb"]))
            held = size
    return out


def _tiles(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the rows of x in parts of at most ``size``, by medians of the widest dimension."""
    parts, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            parts.append(at)
            continue
        column = x[at, int(np.argmax(np.ptp(x[at], axis=0)))]
        order = np.argpartition(column, len(at) // 2)
        todo += [at[order[len(at) // 2:]], at[order[:len(at) // 2]]]
    return parts


@dataclass
class _Side:
    """Queries or candidates of a task; queries have a bound on what is looked for."""
    v: np.ndarray
    id: np.ndarray
    comp: np.ndarray | None
    core: np.ndarray | None
    bound: np.ndarray | None

    @cached_property
    def dims(self) -> np.ndarray:
        """The vectors, a row per dimension."""
        return np.ascontiguousarray(self.v.T)

    @classmethod
    def of(cls, pdf: pd.DataFrame, foreign: bool) -> _Side:
        bound = pdf["_bound"].to_numpy(float) if "_bound" in pdf else np.full(len(pdf), np.inf)
        return cls(np.stack(pdf["_v"].to_numpy()).astype(float), pdf["row_id"].to_numpy(), pdf["_comp"].to_numpy() if foreign else None,
                   pdf["_core"].to_numpy(float) if foreign else None, bound)

    def at(self, some) -> _Side:
        return _Side(*(None if x is None else x[some] for x in (self.v, self.id, self.comp, self.core, self.bound)))


def _candidates(q: _Side, c: _Side, limit: np.ndarray, k: int, metric: Metric, alpha: float, own: bool):
    """(query, candidate, distance) that may be among the k best of a query and at most
    at its limit, with all ties; no distance is left out for rounding."""
    square = metric.base == "euclidean"
    most = limit * alpha
    most = most * most * (1 + 1e-12) if square else most
    at = metric.within(q.v, c.v, most)
    if at is not None and len(at) <= 4 * (k + 1) * len(q.id):
        qi, ci = np.divmod(at, len(c.id))
        if c.comp is not None:
            other = q.comp[qi] != c.comp[ci]
            qi, ci = qi[other], ci[other]
    else:
        qi, ci = _by_rank(q, c, most, k, metric, alpha, own)
    for a in range(0, len(qi), PAIRS_AT_ONCE):
        i, j = qi[a:a + PAIRS_AT_ONCE], ci[a:a + PAIRS_AT_ONCE]
        d = metric.paired(q.dims, c.dims, i, j)
        if c.core is not None:
            d = np.maximum(np.maximum(d / alpha, q.core[i]), c.core[j])
        ok = np.isfinite(d) & (d <= limit[i])
        if own:
            ok &= q.id[i] != c.id[j]  # never your own neighbour
        yield i[ok], j[ok], d[ok]


def _by_rank(q: _Side, c: _Side, most: np.ndarray, k: int, metric: Metric, alpha: float, own: bool):
    """(query, candidate) of at most ``most``; of many, those that may be among the k best."""
    x, base, slack = metric.screened(q.v, c.v)
    square = metric.base == "euclidean"
    keep = ~(x > (most - base + slack)[:, None])
    if c.comp is not None:
        keep &= q.comp[:, None] != c.comp[None, :]
    if np.count_nonzero(keep) > 4 * (k + 1) * len(q.id):
        if own:
            keep &= q.id[:, None] != c.id[None, :]
        x += base[:, None]
        if c.core is not None:
            x = x.astype(float, copy=False)
            x /= alpha * alpha if square else alpha
            slack = slack / (alpha * alpha if square else alpha)
            for core in (q.core[:, None], c.core[None, :]):
                np.maximum(x, core * core if square else core, out=x)
        x[~keep] = np.inf
        kk = min(k, x.shape[1]) - 1
        keep &= ~(x > (np.partition(x, kk, axis=1)[:, kk] * (1 + 1e-12) + 2 * slack)[:, None])
    return np.nonzero(keep)


def _keep_best(dist: np.ndarray, nbr: np.ndarray, limit: np.ndarray, found: list) -> None:
    """Merges what was found, (query, distance, id), into the k best of each query; limits follow."""
    k = dist.shape[1]
    who, far, ids = (np.concatenate(x) for x in zip(*found))
    had = np.unique(who)
    who = np.concatenate([np.repeat(had, k), who])
    far, ids = np.concatenate([dist[had].ravel(), far]), np.concatenate([nbr[had].ravel(), ids])
    order = np.lexsort((ids, far, who))
    who, far, ids = who[order], far[order], ids[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    keep = rank < k
    dist[who[keep], rank[keep]], nbr[who[keep], rank[keep]] = far[keep], ids[keep]
    limit[had] = np.minimum(limit[had], dist[had, k - 1])


def _search(q: _Side, c: _Side, k: int, metric: Metric, alpha: float, own: bool) -> Iterator[pd.DataFrame]:
    """The k best candidates of each query by (distance, id), tile by tile."""
    tiles = [c.at(t) for t in _tiles(c.v, TILE)]
    centres = np.stack([t.v.mean(axis=0) for t in tiles])
    radius = np.array([metric.pairwise(t.v, m[None]).max() for t, m in zip(tiles, centres)])
    for some in _tiles(q.v, QUERY_BLOCK):
        block = q.at(some)
        dist, nbr = np.full((len(some), k), np.inf), np.full((len(some), k), np.iinfo(np.int64).max)
        limit, found, n = block.bound.copy(), [], 0
        gap = metric.pairwise(block.v, centres) - radius
        for t in np.argsort(gap.min(axis=0), kind="stable"):
            open_ = np.flatnonzero(~(gap[:, t] > limit * alpha * (1 + 1e-9) + 1e-12))
            if not len(open_):
                continue
            asked = block if len(open_) == len(some) else block.at(open_)
            for i, j, d in _candidates(asked, tiles[t], limit[open_], k, metric, alpha, own):
                found.append((open_[i], d, tiles[t].id[j]))
                n += len(i)
                if 2 * n >= k * len(some):
                    _keep_best(dist, nbr, limit, found)
                    found, n = [], 0
        if n:
            _keep_best(dist, nbr, limit, found)
        at, rank = np.nonzero(np.isfinite(dist))
        yield pd.DataFrame({"row_id": block.id[at], "nbr": nbr[at, rank], "d": dist[at, rank]})


def _brute_force(k: int, metric: Metric = Metric(), foreign: bool = False, alpha: float = 1.0, own: bool = True):
    """The k nearest candidates of each query by (exact distance, id); with
    ``own`` a query is no candidate of itself. With ``foreign``: candidates of
    other components only, by mutual reachability. A query looks no farther than its
    ``_bound``, if there is that column."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cand = pdf[pdf["_role"] == 1]
        qry = pdf[pdf["_role"] == 0]
        parts = [pd.DataFrame({"row_id": [], "nbr": [], "d": []})]
        if cand.empty or qry.empty:
            return parts[0]
        q, c = _Side.of(qry, foreign), _Side.of(cand, foreign)
        every = np.ones(len(c.id), bool)
        jobs = [(np.ones(len(q.id), bool), every)]
        if foreign:
            # the rows of the largest component need not meet each other
            comps, sizes = np.unique(c.comp, return_counts=True)
            large = comps[np.argmax(sizes)]
            jobs = [(q.comp == large, c.comp != large), (q.comp != large, every)]
        for some, there in jobs:
            if some.any() and there.any():
                parts += _search(q.at(some), c.at(there), k, metric, alpha, own and not foreign)
        return pd.concat(parts[1:] or parts)
    return run


ROOT = -1


def _nearest_kid(metric: Metric):
    """Rows of one node with their nearest child of it (the first by id, if several are as near)."""
    def run(rows: pa.Table, kids: pa.Table) -> pa.Table:
        if not rows.num_rows or not kids.num_rows:
            rows = rows.slice(0, 0)
        kids = kids.sort_by("kid")
        ids, there = kids["kid"].to_numpy(), kids["c"].combine_chunks()
        near, d = np.full(rows.num_rows, ids[0] if len(ids) else ROOT), np.full(rows.num_rows, np.nan)
        some = np.flatnonzero(rows["_v"].is_valid().to_numpy())
        if len(some):
            c = there.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
            v = rows["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1)
            hop = max(1, PAIRS_AT_ONCE // len(ids))
            for i in range(0, len(some), hop):
                far = metric.pairwise(v[i:i + hop], c)
                at = np.where(np.isnan(far), np.inf, far).argmin(axis=1)
                near[some[i:i + hop]], d[some[i:i + hop]] = ids[at], far[np.arange(len(far)), at]
        return rows.select([n for n in rows.column_names if n != "salt"]).append_column("near", pa.array(near, pa.int64())).append_column("d", pa.array(d, pa.float64(), from_pandas=True))
    return run


def _descend(rows: DataFrame, levels: list[DataFrame], metric: Metric) -> DataFrame:
    """``rows`` (with _v) and the way to their cell: ``path`` of (node, d) per level.
    The rows of a node are dealt to several tasks, each with the node's children."""
    rows = rows.withColumn("node", F.lit(ROOT).cast("long")).withColumn("path", F.array().cast("array<struct<node:bigint,d:double>>"))
    for level in levels:
        salts = max(NODE_TASKS, TOP_TASKS // max(level.count(), 1))
        kids = (level.select("node", F.explode("kids").alias("k")).select("node", F.col("k.id").alias("kid"), F.col("k.c").alias("c"))
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
        schema = T.StructType([*rows.schema.fields, T.StructField("near", T.LongType()), T.StructField("d", T.DoubleType())])
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("node", "path")]), F.lit(salts)).cast("int"))
        met = dealt.groupBy("node", "salt").cogroup(kids.groupBy("node", "salt")).applyInArrow(_nearest_kid(metric), schema)
        rows = (met.withColumn("path", F.concat("path", F.array(F.struct(F.col("near").alias("node"), "d"))))
                .withColumn("node", F.col("near")).drop("near", "d"))
    return rows


def point_index(points: DataFrame, vec: str = "reduced", cell_size: int = 2048, seed: int = 42, metric: Metric | str = "euclidean", fan: int = FAN) -> PointIndex:
    """Cells and tree of the points for any number of searches."""
    metric = Metric(metric) if isinstance(metric, str) else metric
    pts = materialize(points.select("row_id", metric.prepared(vec).alias("_v")))
    n = pts.count()
    sizes = [max(1, math.ceil(n / cell_size))]
    while sizes[-1] > fan:
        sizes.append(math.ceil(sizes[-1] / fan))
    draw = F.pmod(F.xxhash64(F.lit(seed), "_v"), F.lit(1 << 52)) / float(1 << 52)
    levels: list[DataFrame] = []
    if sizes[0] > 1:
        drawn = pts.withColumn("draw", draw).where(F.col("draw") < 2 * sizes[0] / n).select("_v", "draw").distinct()
        centres = materialize(contiguous_ids(drawn, "id"))
        for size in reversed(sizes):
            some = centres.where(F.col("draw") < 2 * size / n).select("id", "_v")
            kids = (_descend(some, levels, metric).groupBy("node").agg(F.collect_list(F.struct("id", F.col("_v").alias("c"))).alias("kids")))
            kids = materialize(kids)
            if kids.limit(1).count():  # else no centre was drawn for this level
                levels.append(kids)
    if not levels:
        nsub = max(1, math.ceil(n / cell_size))
        cells = pts.withColumn("cell", F.lit(0).cast("long")).withColumn("sub", F.pmod(F.xxhash64("row_id"), F.lit(nsub)).cast("int"))
        return PointIndex(materialize(cells.withColumn("way", F.array().cast("array<long>"))), [], nsub, metric, n, cell_size)
    placed = materialize(_descend(pts, levels, metric))
    stats = (placed.select(F.posexplode("path").alias("level", "p")).groupBy("level", F.col("p.node").alias("id"))
             .agg(F.max("p.d").alias("r"), F.ceil(F.count(F.lit(1)) / F.lit(cell_size)).cast("int").alias("nsub")))
    stats = materialize(stats)
    tree = []
    for k, level in enumerate(levels):
        kids = level.select("node", F.explode("kids").alias("k")).select("node", "k.id", "k.c").join(stats.where(F.col("level") == k).drop("level"), "id")
        tree.append(materialize(kids.groupBy("node").agg(F.collect_list(F.struct("id", "c", "r", "nsub")).alias("kids"))))
    last = stats.where(F.col("level") == len(levels) - 1).select(F.col("id").alias("node"), "nsub")
    cells = placed.join(last, "node").select("row_id", "_v", F.col("node").alias("cell"), F.pmod(F.xxhash64("row_id"), F.col("nsub")).cast("int").alias("sub"), F.col("path.node").alias("way"))
    return PointIndex(materialize(cells), tree, 0, metric, n, cell_size)


def _groups(cand: DataFrame, queries: DataFrame, run, split: bool = False) -> DataFrame:
    """Queries (with a cell and sub-cell each) against its candidates. With ``split``,
    many queries of one sub-cell are dealt to several tasks, each with its candidates."""
    if split:
        queries = materialize(queries)
        load = queries.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES_PER_TASK)).cast("int").alias("pieces"))
        queries = queries.join(load, ["cell", "sub"]).withColumn("piece", F.pmod(F.xxhash64("row_id"), F.col("pieces")).cast("int")).drop("pieces")
        cand = cand.join(load, ["cell", "sub"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    else:
        queries, cand = queries.withColumn("piece", F.lit(0)), cand.withColumn("piece", F.lit(0))
    q = queries.withColumn("_role", F.lit(0))
    c = cand.withColumn("_role", F.lit(1)).select(*q.columns)
    return q.unionByName(c).groupBy("cell", "sub", "piece").applyInPandas(run, EDGE_SCHEMA)


def _reachable(index: PointIndex, queries: DataFrame) -> DataFrame:
    """A row for each query and (cell, sub-cell) that may hold a point within
    the query's bound ``r``: a walk down the tree, one join per level."""
    keep = [c for c in queries.columns if c != "r"]
    if not index.levels:
        subs = F.explode(F.sequence(F.lit(0), F.lit(index.nsub - 1)))
        return queries.select(*keep, F.lit(0).cast("long").alias("cell"), subs.alias("sub"))
    q = queries.withColumn("node", F.lit(ROOT).cast("long")).withColumn("nsub", F.lit(1))
    for level in index.levels:
        within = F.filter("kids", lambda c: index.metric.between("_v", c["c"]) - c["r"] <= F.col("r") * (1 + 1e-9) + 1e-12)
        q = (q.join(level, "node").select(*keep, "r", F.explode(within).alias("kid"))
             .select(*keep, "r", F.col("kid.id").alias("node"), F.col("kid.nsub").alias("nsub")))
    return q.select(*keep, F.col("node").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("nsub") - 1)).alias("sub"))


def knn_graph(points: DataFrame, k: int, vec: str = "reduced", cell_size: int = 2048,
              seed: int = 42, index: PointIndex | None = None, metric: Metric | str = "euclidean") -> DataFrame:
    """(row_id, nbr, d, rank) for the k nearest other points, exact; equal
    distances go to the smaller id."""
    index = index or point_index(points, vec, cell_size, seed, metric)
    cells = index.cells
    run = _brute_force(k, index.metric)
    if not index.walks(index.n):
        return _ranked(_merge(_in_blocks(index, index.dealt, index.dealt.withColumn("_bound", F.lit(float("inf"))), run, k), k), index.metric)
    cand = cells.select("row_id", "_v", "cell", "sub")
    first = materialize(_groups(cand, cand, run))
    merged = _merge(first, k)
    if not index.levels and index.nsub == 1:
        return _ranked(merged, index.metric)
    # refinement: cells whose lower bound does not exceed the current k-th distance
    kth = merged.select("row_id", F.when(F.size("top") >= k, F.col("top")[k - 1]["d"])
                        .otherwise(F.lit(float("inf"))).alias("r"))
    info = (cells.withColumnRenamed("cell", "_cell").withColumnRenamed("sub", "_sub").join(kth, "row_id", "left")
            .withColumn("r", F.coalesce("r", F.lit(float("inf")))))
    again = (_reachable(index, info).where(~((F.col("_cell") == F.col("cell")) & (F.col("_sub") == F.col("sub"))))
             .select("row_id", "_v", "cell", "sub"))
    return _ranked(_merge(first.unionByName(_groups(cand, again, run, split=True)), k), index.metric)


def knn_search(index: PointIndex, queries: DataFrame, k: int, vec: str = "reduced") -> DataFrame:
    """(row_id, nbr, d, rank): the k nearest indexed points of other rows. Query
    ids may equal ids of indexed points."""
    cand, run = index.cells.select("row_id", "_v", "cell", "sub"), _brute_force(k, index.metric, own=False)
    q = queries.select("row_id", index.metric.prepared(vec).alias("_v"))
    if not index.walks(queries.count()):
        placed = materialize(_descend(q, index.levels, index.metric).select("row_id", "_v", F.col("path.node").alias("way")))
        blocks = _dealt(placed, ["way", "row_id"], index.cell_size).withColumn("_bound", F.lit(float("inf")))
        return _ranked(_merge(_in_blocks(index, index.dealt, blocks, run, k), k), index.metric)
    if not index.levels:
        return _ranked(_merge(_groups(cand, _reachable(index, q), run, split=True), k), index.metric)
    near = materialize(_descend(q, index.levels, index.metric).select("row_id", "_v", F.col("node").alias("_cell")))
    subs = index.levels[-1].select(F.explode("kids").alias("k")).select(F.col("k.id").alias("_cell"), F.col("k.nsub").alias("nsub"))
    own = near.join(subs, "_cell").select("row_id", "_v", F.col("_cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("nsub") - 1)).alias("sub"))
    first = materialize(_groups(cand, own, run, split=True))
    kth = _merge(first, k).select("row_id", F.when(F.size("top") >= k, F.col("top")[k - 1]["d"]).otherwise(F.lit(float("inf"))).alias("r"))
    info = near.join(kth, "row_id", "left").withColumn("r", F.coalesce("r", F.lit(float("inf"))))
    again = _reachable(index, info).where(F.col("_cell") != F.col("cell")).select("row_id", "_v", "cell", "sub")
    return _ranked(_merge(first.unionByName(_groups(cand, again, run, split=True)), k), index.metric)


def foreign_neighbours(index: PointIndex, labelled: DataFrame, queries: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(row_id, nbr, d): for each query the point of another component that is
    nearest by mutual reachability (of base distances), if it is within the query's bound.

    ``labelled`` has (row_id, comp, core) of all indexed points, ``queries``
    (row_id, bound). Mutual reachability is never below distance / alpha, so a cell
    farther off than bound * alpha cannot matter."""
    run = _brute_force(1, index.metric, foreign=True, alpha=alpha)
    nearest = lambda e: e.groupBy("row_id").agg(F.min(F.struct("d", "nbr")).alias("m")).select("row_id", "m.nbr", "m.d")
    queries = materialize(queries)
    n_queries = queries.count()
    if not index.walks(n_queries):
        cand = materialize(index.dealt.join(labelled, "row_id").select("row_id", "_v", "pos", "block", F.col("comp").alias("_comp"), F.col("core").alias("_core")))
        some = cand.drop("block").join(queries.withColumnRenamed("bound", "_bound"), "row_id")
        return nearest(_in_blocks(index, cand.drop("pos"), _dealt(some, ["pos"], index.cell_size).drop("pos"), run, 1, alpha))
    cand = (index.cells.join(labelled, "row_id").select("row_id", "_v", "cell", "sub", F.col("comp").alias("_comp"),
                                                        F.col("core").alias("_core")))
    q = cand.drop("cell", "sub").join(queries, "row_id").withColumn("r", F.col("bound") * F.lit(alpha)).drop("bound")
    return nearest(_groups(cand, _reachable(index, q), run))


def approximate_knn(points: DataFrame, k: int, vec: str = "reduced", tables: int = 8, bucket: int = 1024, rounds: int = 3, seed: int = 42,
                    metric: Metric | str = "euclidean") -> DataFrame:
    """(row_id, nbr, d, rank): about the k nearest other points, in time that does not
    depend on how well bounds prune (for many dimensions).

    ``tables`` times, random projections of the centred vectors cut the points into
    buckets of about ``bucket`` points (a fuller one is split by a hash of the row id,
    differently each time), which are searched by brute force. Then ``rounds``
    times, a point also looks at its neighbours' neighbours and at the points that list
    it, ``2 * k`` of those at most per point (NN-descent); every candidate's exact distance is kept.
    Recall depends on the data; ``D10_approximate_knn`` reports it."""
    metric = Metric(metric) if isinstance(metric, str) else metric
    pts = materialize(points.select("row_id", metric.prepared(vec).alias("_v")))
    n = pts.count()
    if not n:
        return pts.sparkSession.createDataFrame([], EDGE_SCHEMA + ", rank int")
    dim = V.vector_dim(pts, "_v")
    mean = [float(x) for x in pts.select(V.mean_vector("_v", dim).alias("m")).first()["m"]]
    bits = max(0, math.ceil(math.log2(max(1, n / bucket))))
    rng = np.random.default_rng(seed)
    run, found = _brute_force(k, metric), None
    for t in range(tables if bits else 1):
        cell = F.lit(0).cast("long")
        for _ in range(bits):
            w = rng.normal(size=dim)
            at = float(np.dot(w, mean))
            side = F.aggregate(F.zip_with("_v", F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) > at
            cell = cell * 2 + side.cast("long")
        dealt = pts.withColumn("cell", cell)
        nsub = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * bucket)).cast("int").alias("nsub"))
        dealt = materialize(dealt.join(nsub, "cell").withColumn("sub", F.pmod(F.xxhash64("row_id", F.lit(t)), F.col("nsub")).cast("int")).drop("nsub"))
        part = _groups(dealt, dealt, run)
        found = part if found is None else found.unionByName(part)
    best = materialize(_ranked(_merge(found.distinct(), k), Metric()))
    for _ in range(rounds if bits else 0):
        listed = best.select("row_id", "nbr", "rank")
        back = listed.select(F.col("nbr").alias("row_id"), F.col("row_id").alias("nbr"), "rank")
        # a point that very many list keeps the closest 2k of them here; all of them keep the point
        back = back.withColumn("i", F.row_number().over(Window.partitionBy("row_id").orderBy("rank", "nbr"))).where(F.col("i") <= 2 * k).select("row_id", "nbr")
        near = materialize(listed.select("row_id", "nbr").unionByName(back).distinct())
        two = (near.select(F.col("nbr").alias("via"), "row_id").join(near.select(F.col("row_id").alias("via"), "nbr"), "via")
               .where(F.col("row_id") != F.col("nbr")).select("row_id", "nbr").unionByName(near).distinct())
        two = two.join(listed.select("row_id", "nbr"), ["row_id", "nbr"], "left_anti")
        there = pts.select(F.col("row_id").alias("nbr"), F.col("_v").alias("_w"))
        new = two.join(pts, "row_id").join(there, "nbr").select("row_id", "nbr", metric.between("_v", "_w").alias("d"))
        best = materialize(_ranked(_merge(best.select("row_id", "nbr", "d").unionByName(new), k), Metric()))
    return best.withColumn("d", metric.reported(F.col("d")))


def _merge(edges: DataFrame, k: int) -> DataFrame:
    return (edges.groupBy("row_id")
            .agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "nbr"))), 1, k).alias("top")))


def _ranked(merged: DataFrame, metric: Metric) -> DataFrame:
    return (merged.select("row_id", F.posexplode("top").alias("pos", "t"))
            .select("row_id", F.col("t.nbr").alias("nbr"), metric.reported(F.col("t.d")).alias("d"),
                    (F.col("pos") + 1).cast("int").alias("rank")))


def brute_force_knn(points: DataFrame, k: int, vec: str = "reduced") -> pd.DataFrame:
    """Test helper: exact kNN by NumPy on a small local fixture."""
    pdf = points.select("row_id", V.as_double(vec).alias("v")).toPandas()
    X = np.stack(pdf["v"].to_numpy())
    ids = pdf["row_id"].to_numpy()
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    rows = []
    for i in range(len(ids)):
        order = np.lexsort((ids, d[i]))[:k]
        for r, j in enumerate(order):
            rows.append((int(ids[i]), int(ids[j]), float(d[i, j]), r + 1))
    return pd.DataFrame(rows, columns=["row_id", "nbr", "d", "rank"])


def memberships(knn: DataFrame, k: int, n_iter: int = 64) -> DataFrame:
    """(i, j, w, d): fuzzy membership of each directed kNN edge.

    Per row: rho = distance to the nearest neighbour at distance > 0, sigma
    found by bisection (``n_iter`` steps for a batch of rows at once)
    so that ``sum_j exp(-max(0, d_ij - rho) / sigma) = log2(k)``.
    """
    target = math.log2(max(k, 2))
    rows = knn.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("d", "nbr"))).alias("nb"))
    rho = F.coalesce(F.array_min(F.filter(F.transform("nb", lambda t: t["d"]), lambda d: d > 0)), F.lit(0.0))
    rows = rows.select("row_id", "nb", rho.alias("rho"))

    def bisect(batches):
        for b in batches:
            size = pc.list_value_length(b["nb"]).to_numpy(zero_copy_only=False)
            over = np.full((len(size), int(size.max(initial=0))), np.inf)
            over[np.arange(over.shape[1]) < size[:, None]] = b["nb"].flatten().field("d").to_numpy(zero_copy_only=False)
            over = np.maximum(over - b["rho"].to_numpy(zero_copy_only=False)[:, None], 0.0).T
            lo, hi, mid = np.zeros(len(size)), np.full(len(size), np.inf), np.ones(len(size))
            for _ in range(n_iter):
                big = sum((np.exp(-d / mid) for d in over), np.zeros(len(size))) > target
                lo, hi = np.where(big, lo, mid), np.where(big, mid, hi)
                mid = np.where(np.isinf(hi), lo * 2, (lo + hi) / 2)
            yield b.append_column("sigma", pa.array(np.maximum(mid, 1e-12)))

    rows = rows.mapInArrow(bisect, T.StructType([*rows.schema.fields, T.StructField("sigma", T.DoubleType())]))
    return (rows.select("row_id", "rho", "sigma", F.explode("nb").alias("t"))
                .select(F.col("row_id").alias("i"), F.col("t.nbr").alias("j"),
                        F.exp(-F.greatest(F.col("t.d") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("w"), F.col("t.d").alias("d")))


def fuzzy_graph(knn: DataFrame, k: int, n_iter: int = 64) -> DataFrame:
    """D10 neighbour-graph variant: the fuzzy union ``a + b - a*b`` of the graph of
    :func:`memberships` with its transpose: one aggregate on the (unordered) edge key."""
    directed = memberships(knn, k, n_iter)
    fwd = directed.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"),
                          F.when(F.col("i") < F.col("j"), F.col("w")).alias("w_ab"),
                          F.when(F.col("i") > F.col("j"), F.col("w")).alias("w_ba"))
    both = fwd.groupBy("a", "b").agg(F.max("w_ab").alias("p"), F.max("w_ba").alias("q"))
    p, q = F.coalesce(F.col("p"), F.lit(0.0)), F.coalesce(F.col("q"), F.lit(0.0))
    return both.select("a", "b", (p + q - p * q).alias("w"))
