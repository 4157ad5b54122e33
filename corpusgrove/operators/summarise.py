"""Group summaries and statistics.

Everything here is hash aggregation with map-side partial aggregation, so a
group holding a third of the rows collapses to one partial row per task before
the shuffle. Per-group results are joined back with a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.materialize import materialize
from ..functions.sizing import broadcast_budget, fits_broadcast, row_count


class StageInputError(ValueError):
    """A stage was asked to run on rows that miss its input column."""


def require_no_nulls(df: DataFrame, *cols: str) -> None:
    """One aggregate pass counting nulls in the input columns."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    bad = {c: row[c] for c in cols if row[c]}
    if bad:
        raise StageInputError(f"null values in stage input: {bad}")


def noise_counts(train: DataFrame) -> DataFrame:
    """Rows with predict = -1 and the rest (has_group counts every row
    that is not noise, as the reference does)."""
    return train.agg(
        F.count_if(F.col("predict") == -1).alias("no_group"),
        (F.count(F.lit(1)) - F.count_if(F.col("predict") == -1)).alias("has_group"),
    )


def group_counts(train: DataFrame) -> DataFrame:
    """Rows per group, noise excluded, null text not counted."""
    return (train.where(F.col("predict") != -1)
            .groupBy(F.col("predict").alias("group"))
            .agg(F.count("text").alias("count")))


def centroids(train: DataFrame, dim: int, vec: str = "reduced") -> DataFrame:
    """E2-E4 in one aggregate: count, elementwise mean vector, mean x / y."""
    return (train.where(F.col("predict") != -1)
            .groupBy(F.col("predict").alias("group"))
            .agg(V.mean_vector(vec, dim).alias("mean"),
                 F.avg("x").alias("x"), F.avg("y").alias("y"),
                 F.count("text").alias("count")))


def _attach_groups(members: DataFrame, groups: DataFrame, key: str, n_groups: int,
                   row_bytes: int) -> DataFrame:
    """Join per-group values to member rows; broadcast only when the group
    table is proven small, otherwise a shuffled join (AQE splits skew)."""
    spark = members.sparkSession
    if fits_broadcast(n_groups, row_bytes, broadcast_budget(spark)):
        groups = F.broadcast(groups)
    return members.join(groups, key)


def group_summaries(train: DataFrame, dim: int | None = None, vec: str = "reduced",
                    metric: str = "euclidean") -> DataFrame:
    """Group, mean, x, y, count, distance (radius), max_dist, rel_size,
    repr_id, repr_text.

    * E3 centroid: elementwise mean of the member vectors.
    * E5 representative: member nearest the centroid, ties to the lowest id.
    * E6 radius: max - min member distance to the centroid (kept as the
      reference defines it); ``max_dist`` beside it.
    * E7 rel_size: radius / smallest radius, NULL when that is 0.
    Group keys need not be 0..k-1.
    """
    if dim is None:
        dim = V.vector_dim(train, vec)
    cents = centroids(train, dim, vec)
    cents = materialize(cents)
    n_groups = row_count(cents)
    members = train.where(F.col("predict") != -1).select(
        F.col("predict").alias("group"), "row_id", "text", vec)
    joined = _attach_groups(members, cents.select("group", "mean"), "group", n_groups,
                            row_bytes=16 + 8 * dim)
    d = V.distance(vec, "mean", metric)
    per_group = (joined.withColumn("d", d)
                 .groupBy("group")
                 .agg(F.max("d").alias("max_dist"),
                      (F.max("d") - F.min("d")).alias("distance"),
                      F.min(F.struct("d", "row_id"))["row_id"].alias("repr_id")))
    per_group = materialize(per_group)
    # texts join the chosen rows only; an id with several texts gives the smallest of them
    texts = (_attach_groups(members.select("group", "row_id", "text"), per_group.select("group", "repr_id"), "group", n_groups, row_bytes=24)
             .where(F.col("row_id") == F.col("repr_id")).groupBy("group").agg(F.min("text").alias("repr_text")))
    out = materialize(cents.join(per_group, "group").join(texts, "group", "left"))
    min_radius = out.select(F.min("distance")).scalar()
    # one row per group: written once, so the size checks, scalar subqueries
    # and joins downstream never re-run the member aggregation
    return materialize(out.select(
        F.col("group").cast("int").alias("group"), "mean", "x", "y", "count", "distance", "max_dist",
        F.try_divide(F.col("distance"), F.nullif(min_radius, F.lit(0.0))).alias("rel_size"),
        "repr_id", "repr_text",
    ))


def max_distance(summaries: DataFrame, dim: int) -> DataFrame:
    """2 x the largest distance from a centroid to the unweighted mean of
    centroids; NULL when that is 0 (a single group)."""
    centre = summaries.select(V.mean_vector("mean", dim).alias("c")).scalar()
    return (summaries.withColumn("c", centre)
            .agg((2 * F.max(V.euclidean("mean", "c"))).alias("m"))
            .select(F.nullif(F.col("m"), F.lit(0.0)).alias("max_distance")))


def group_stats(train: DataFrame, summaries: DataFrame, dim: int) -> DataFrame:
    """One row num_group, no_group, has_group, max_distance."""
    n = summaries.agg(F.count(F.lit(1)).alias("num_group"))
    return (noise_counts(train)
            .select(n.select("num_group").scalar().alias("num_group"), "no_group", "has_group",
                    max_distance(summaries, dim).select("max_distance").scalar().alias("max_distance")))


def grouped_share(stats: DataFrame) -> DataFrame:
    """Grouped vs ungrouped share of the train rows."""
    total = F.col("no_group") + F.col("has_group")
    return stats.select(
        F.try_divide(F.col("has_group").cast("double"), total).alias("grouped_share"),
        F.try_divide(F.col("no_group").cast("double"), total).alias("ungrouped_share"))


def groups_ranked_by_count(summaries: DataFrame) -> DataFrame:
    """Groups ordered by count desc, then group id, with a rank.

    The sort is a range-partitioned global sort; the rank is computed from
    per-partition offsets (no single-partition window)."""
    from .ids import contiguous_ids
    ordered = summaries.orderBy(F.col("count").desc(), F.col("group").asc())
    return contiguous_ids(ordered, "rank", start=1)
