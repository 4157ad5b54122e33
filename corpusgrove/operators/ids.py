"""Contiguous row ids without a single-partition window.

Each row gets (partition, position-in-partition) from
``monotonically_increasing_id``; a per-partition count (one row per partition)
gives offsets, which are broadcast back. The broadcast side has as many rows
as the input has partitions, a bound that does not grow with row count per
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialize import materialize


def ordered_ids(df: DataFrame, by: list[str], col: str = "row_id", start: int = 0) -> DataFrame:
    """Number rows in the order of the columns ``by``, which name runs of rows that
    were read one after another by one task (file and block of a scan), and
    inside a run as read. Rows are not shuffled: the offsets table, broadcast back,
    has one row per run."""
    tagged = materialize(df.withColumn("_mid", F.monotonically_increasing_id()))
    runs = tagged.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*by, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), by).withColumn(col, F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(start))
            .drop(*by, "_mid", "_first", "_off"))


def contiguous_ids(df: DataFrame, col: str = "row_id", start: int = 0) -> DataFrame:
    """Number rows 0..n-1 (plus ``start``) in the current partition order.

    For a globally sorted input (``orderBy``) this follows the sort order.
    The tagged input is checkpointed first so both passes see the same rows in
    the same partitions.
    """
    tagged = materialize(df.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(col, F.col("_off") + pos + F.lit(start))
            .drop("_pid", "_mid", "_off"))
