"""Paged search (B19) with presentation options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import compile_criteria

PAGE_COLUMNS = ("text", "ts", "ref", "target", "predict")


def search_counts(df: DataFrame, criteria: str | None = None, **kw) -> DataFrame:
    """B19 counts: total and filtered rows in one aggregate pass."""
    pred = compile_criteria(criteria, **kw)
    flt = F.count(F.lit(1)) if pred is None else F.count_if(F.coalesce(pred, F.lit(False)))
    return df.agg(F.count(F.lit(1)).alias("total"), flt.alias("filtered"))


def search_page(df: DataFrame, criteria: str | None = None, start: int = 0, count: int = 20,
                after_id: int | None = None, **kw) -> DataFrame:
    """B19 page: rows ordered by id. ``count < 0`` means all rows from
    ``start`` (fixes the lost last row of Q13). ``after_id`` gives keyset
    paging (``row_id > after_id``), which stays cheap for deep pages."""
    pred = compile_criteria(criteria, **kw)
    rows = df if pred is None else df.where(pred)
    if after_id is not None:
        rows = rows.where(F.col("row_id") > after_id)
    rows = rows.select(F.col("row_id").alias("id"), *PAGE_COLUMNS).orderBy("id")
    if start:
        rows = rows.offset(start)
    if count is not None and count >= 0:
        rows = rows.limit(count)
    return rows


def null_to_empty(df: DataFrame, cols=None) -> DataFrame:
    """NULL -> '' for output records (values become strings)."""
    cols = cols or df.columns
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def truncate_text(col: str = "text", n: int = 80) -> F.Column:
    """First ``n`` characters."""
    return F.substring(F.col(col), 1, n)
