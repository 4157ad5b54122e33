"""Size checks that decide between a broadcast value and a shuffled path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A centroid list embedded into every task must stay below this many bytes.
DEFAULT_BROADCAST_BUDGET = 32 * 1024 * 1024


def broadcast_budget(spark) -> int:
    v = spark.conf.get("corpusgrove.broadcastBudgetBytes", None)
    return int(v) if v else DEFAULT_BROADCAST_BUDGET


def row_count(df: DataFrame) -> int:
    """Count of a small, already materialised derived table (groups, blocks)."""
    return int(df.agg(F.count(F.lit(1)).alias("n")).first()["n"])


def fits_broadcast(n_rows: int, row_bytes: int, budget: int) -> bool:
    return n_rows * max(row_bytes, 1) <= budget
