"""Transitions between groups in consecutive turns of a conversation.

A conversation may hold a large share of all turns, so "next turn" is not a
window over the whole conversation. Turns are split into buckets of
``bucket`` consecutive turn numbers; ``lead`` runs inside each bucket, and the
last turn of a bucket takes its successor from the first turn of the next
non-empty bucket (one row per bucket, so that second window is small).
Each task therefore sorts at most ``bucket`` turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_in_sequence(df: DataFrame, key: str, order: str, value: str, bucket: int = 4096) -> DataFrame:
    """Add ``next_<value>``: the value of the next row by ``order`` within
    ``key`` (NULL for the last row)."""
    nxt = f"next_{value}"
    b = F.floor(F.col(order) / F.lit(bucket))
    rows = df.withColumn("_b", b)
    w_in = Window.partitionBy(key, "_b").orderBy(order)
    rows = rows.withColumn(nxt, F.lead(value).over(w_in)).withColumn("_last", F.lead(order).over(w_in).isNull())
    firsts = (rows.groupBy(key, "_b")
              .agg(F.min_by(F.col(value), F.col(order)).alias("_first"))
              .withColumn("_carry", F.lead("_first").over(Window.partitionBy(key).orderBy("_b")))
              .select(key, "_b", "_carry"))
    out = rows.join(firsts, [key, "_b"], "left")
    return (out.withColumn(nxt, F.when(F.col("_last"), F.col("_carry")).otherwise(F.col(nxt)))
            .drop("_b", "_last", "_carry"))


def flow_patterns(turns: DataFrame, key: str = "conv_id", order: str = "turn", group: str = "predict",
                  bucket: int = 4096) -> DataFrame:
    """Count of (from_group, to_group) over consecutive turns."""
    seq = next_in_sequence(turns.select(key, order, F.col(group).alias("_g")), key, order, "_g", bucket)
    return (seq.where(F.col("next__g").isNotNull() & F.col("_g").isNotNull())
            .groupBy(F.col("_g").alias("from_group"), F.col("next__g").alias("to_group"))
            .agg(F.count(F.lit(1)).alias("transitions")))
