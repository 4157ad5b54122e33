"""Parquet tables and the canonical corpus built from them.

The canonical corpus (see FIXTURES.md §3) maps the driver's tables onto the
corpus schema: documents give text and ref, embeddings give the vectors and
the given group label, events give a timestamp, labels give a target.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; projection and filters push into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def canonical_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows that have a vector and a time: documents ⋈ embeddings ⋈
    events, left ⋈ labels."""
    return _corpus(spark, sf_dir, "inner")


def _corpus(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    """All joins are equi-joins on the document id, so Catalyst plans them as
    shuffle (or size-checked broadcast) hash joins; only the needed columns are
    read from each file."""
    d = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), "text", F.col("source").alias("ref"))
    e = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("predict"))
    v = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "ts")
    lab = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("target"))
    reduced = F.col("embedding").cast(T.ArrayType(T.DoubleType()))
    return (
        d.join(e, "row_id", how).join(v, "row_id", how).join(lab, "row_id", "left")
        .select(
            "row_id", "text", "embedding",
            reduced.alias("reduced"),
            reduced[0].alias("x"), reduced[1].alias("y"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            "ref", "target",
            F.col("predict").cast("int").alias("predict"),
            F.lit(None).cast("double").alias("distance"),
            F.when(F.col("row_id") % 5 == 0, F.lit("dev")).otherwise(F.lit("train")).alias("set"),
        )
    )


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as corpus rows; vector, time and label where there are any."""
    return _corpus(spark, sf_dir, "left")


def train_rows(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("set") == "train")


def dev_rows(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("set") == "dev")


# The same corpus as DuckDB SQL, for oracle queries.
CANONICAL_CORPUS_SQL = """
SELECT d.doc_id AS row_id, d.text AS text, e.embedding AS embedding,
       CAST(e.embedding AS DOUBLE[]) AS reduced,
       CAST(e.embedding[1] AS DOUBLE) AS x, CAST(e.embedding[2] AS DOUBLE) AS y,
       v.ts AS ts, d.source AS ref, CAST(l.quality AS INTEGER) AS target,
       CAST(e.label AS INTEGER) AS predict, CAST(NULL AS DOUBLE) AS distance,
       CASE WHEN d.doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS "set"
FROM documents d
JOIN embeddings e ON e.vec_id = d.doc_id
JOIN events v ON v.event_id = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

TEXT_CORPUS_SQL = CANONICAL_CORPUS_SQL.replace("\nJOIN ", "\nLEFT JOIN ")
