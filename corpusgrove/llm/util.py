"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialize  # noqa: F401  (lineage cut in the shared folder)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, bytes of text) of the whole table: one cheap aggregate."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def bucket_of(col: str | Column, n: int) -> Column:
    """Even bucket number of a key, the same in every run."""
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def held_out(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % m


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(run, schema)


def drawn(labels: DataFrame, label_col: str, id_col: str, most: dict[int, int], seed: int):
    """A bounded draw of labelled rows by a hash of the id: (doc_id, y, h),
    rows by label, share drawn of each label. ``most`` is about the number of
    rows per label."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    rate = {y: min(1.0, n / sizes[y]) if sizes.get(y) else 0.0 for y, n in most.items()}
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1_000_000))
    limit = F.when(F.col("y") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0)) * 1_000_000
    return rows.withColumn("h", h).where(F.col("h") < limit), sizes, rate


def with_rest(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """id, text and the columns to carry along, as one struct."""
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))


def rest_type(df: DataFrame) -> str:
    return df.schema["rest"].dataType.simpleString()
