"""Rows x centroids: nearest groups.

The centroid table is small next to the corpus (one row per group), but it
grows with the number of groups, so its size is checked:

* fits the broadcast budget: the whole centroid list becomes one scalar
  subquery value that every task reads; each row is scored in a narrow
  projection (no shuffle of the rows at all);
* otherwise: a pruned block join. The centroids become the leaves of a cell tree
  (:mod:`corpusgrove.operators.neighbours`), in blocks of about ``block_size``. A row
  walks down the tree by joins to its own block, which gives it a k-th distance,
  and then meets only the blocks whose centre and radius allow a nearer centroid
  (triangle inequality). Rows of a hot block are dealt to several tasks;
* a metric without a triangle inequality (braycurtis) cannot be pruned: there a row
  meets every block, through an equi-join on ``(block, salt)`` (the salt spreads
  the rows of one block over many tasks).

A row without a vector has no nearest group (``top`` is empty); repeated and null row ids
are told apart by a row number of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.materialize import materialize
from ..functions.sizing import broadcast_budget
from . import neighbours


TOP = "array<struct<d:double,g:int,r:double>>"


def _score_block(cands, vec: str, metric: str, k: int):
    """Top-k (distance, group, radius) structs of one row against a candidate
    list, ties broken by the lower group id."""
    scored = F.transform(cands, lambda c: F.struct(
        V.distance(vec, c["mean"], metric).alias("d"), c["group"].alias("g"), c["r"].alias("r")))
    return F.slice(F.array_sort(F.filter(scored, lambda t: t["d"].isNotNull())), 1, k)


def nearest_groups(rows: DataFrame, cents: DataFrame, k: int = 1, vec: str = "reduced",
                   metric: str = "euclidean", block_size: int = 1024,
                   salt: int = 64, budget: int | None = None) -> DataFrame:
    """Add ``top`` = array of up to k structs (d, g, r), nearest first.

    ``cents`` has columns ``group`` and ``mean``; ``rows`` has ``vec``. Fewer
    than k groups gives a shorter array.
    """
    spark = rows.sparkSession
    budget = broadcast_budget(spark) if budget is None else budget
    radius = F.col("distance").cast("double") if "distance" in cents.columns else F.lit(None).cast("double")
    cents = cents.select(F.col("group").cast("int").alias("group"),
                         V.as_double("mean").alias("mean"), radius.alias("r"))
    size_row = cents.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("mean")).alias("d")).first()
    n_groups, dim = int(size_row["n"]), int(size_row["d"] or 0)
    est_bytes = n_groups * (16 + 8 * dim)
    if est_bytes <= budget:
        cand_list = cents.select(F.collect_list(F.struct("group", "mean", "r")).alias("c")).scalar()
        return (rows.withColumn("_cands", cand_list)
                .withColumn("top", _score_block(F.col("_cands"), vec, metric, k))
                .drop("_cands"))
    tagged = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    queries = tagged.where(F.col(vec).isNotNull()).select(F.col("_row").alias("row_id"), F.col(vec).alias("_q"))
    try:
        neighbours.Metric(metric)
    except neighbours.MetricError:
        found = _every_block(queries, cents, k, metric, max(1, math.ceil(n_groups / block_size)), salt)
    else:
        found = _allowed_blocks(queries, cents, k, metric, block_size)
    return (tagged.join(found.select(F.col("row_id").alias("_row"), "top"), "_row", "left")
            .withColumn("top", F.coalesce("top", F.array().cast(TOP))).drop("_row"))


def _allowed_blocks(queries: DataFrame, cents: DataFrame, k: int, metric: str, block_size: int) -> DataFrame:
    """(row_id, top): rows meet the blocks of centroids that the triangle inequality leaves."""
    cents = materialize(cents.where(F.col("mean").isNotNull()))
    points = cents.select(F.col("group").cast("long").alias("row_id"), "mean")
    index = neighbours.point_index(points, "mean", cell_size=block_size, metric=metric)
    near = neighbours.knn_search(index, queries, k, "_q")
    radii = cents.select(F.col("group").cast("long").alias("nbr"), "r")
    one = F.struct("d", F.col("nbr").cast("int").alias("g"), "r")
    return near.join(radii, "nbr").groupBy("row_id").agg(F.array_sort(F.collect_list(one)).alias("top"))


def _every_block(queries: DataFrame, cents: DataFrame, k: int, metric: str, n_blocks: int, salt: int) -> DataFrame:
    """(row_id, top): rows meet all blocks, and the tops of the blocks are merged."""
    blocks = (cents.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(n_blocks)))
              .groupBy("block").agg(F.collect_list(F.struct("group", "mean", "r")).alias("_cands"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))))
    spread = (queries.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salt)))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))
    per_block = (spread.join(blocks, ["block", "salt"])
                 .select("row_id", _score_block(F.col("_cands"), "_q", metric, k).alias("part")))
    return per_block.groupBy("row_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("part"))), 1, k).alias("top"))


def assign_nearest(dev: DataFrame, summaries: DataFrame, vec: str = "reduced",
                   metric: str = "euclidean", **kw) -> DataFrame:
    """Every dev row gets its nearest group and the distance (never -1)."""
    out = nearest_groups(dev, summaries, k=1, vec=vec, metric=metric, **kw)
    return (out.withColumn("predict", F.get("top", 0)["g"])
            .withColumn("distance", F.get("top", 0)["d"])
            .drop("top"))


def score_rows(rows: DataFrame, summaries: DataFrame, vec: str = "reduced",
               metric: str = "euclidean", **kw) -> DataFrame:
    """Top-3 groups per row; ``predict`` is the nearest group when the
    distance is within that group's radius (``distance`` of E6), else -1.
    ``choice2/3`` and ``distance2/3`` are NULL when there are fewer groups.
    ``nearest`` keeps the nearest group without the radius rule (Q15)."""
    taken = ("predict", "distance", "distance2", "distance3", "choice1", "choice2", "choice3",
             "radius", "nearest")
    rows = rows.drop(*[c for c in taken if c in rows.columns])
    out = nearest_groups(rows, summaries, k=3, vec=vec, metric=metric, **kw)
    top = F.col("top")
    out = out.select(
        "*",
        F.get(top, 0)["g"].alias("choice1"), F.get(top, 1)["g"].alias("choice2"), F.get(top, 2)["g"].alias("choice3"),
        F.get(top, 0)["d"].alias("distance"), F.get(top, 1)["d"].alias("distance2"), F.get(top, 2)["d"].alias("distance3"),
        F.get(top, 0)["r"].alias("radius"),
    ).drop("top")
    return (out.withColumn("nearest", F.col("choice1"))
            .withColumn("predict", F.when(F.col("distance") <= F.col("radius"), F.col("choice1"))
                        .otherwise(F.lit(-1))))


def confidence(scored: DataFrame) -> DataFrame:
    """least(1, 1 - distance / radius of choice1); no lower clamp.
    A zero radius gives NULL instead of a division error."""
    return scored.withColumn(
        "confidence",
        F.least(F.lit(1.0), F.lit(1.0) - F.try_divide(F.col("distance"), F.nullif(F.col("radius"), F.lit(0.0)))))


def read_scored(scored: DataFrame) -> DataFrame:
    """The scored table without vector columns."""
    drop = [c for c in ("embedding", "reduced") if c in scored.columns]
    return scored.drop(*drop)
