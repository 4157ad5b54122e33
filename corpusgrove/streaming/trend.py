"""Streaming group trend with fixed-width windows and a watermark.

Adaptive bins (E19) need the whole time range, so the streaming form uses
fixed windows; the watermark bounds the state kept for late rows. Append
mode emits a window once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed_trend(stream: DataFrame, ts: str = "ts", group: str = "predict", width: str = "1 day",
                   watermark: str = "1 hour", dedupe: bool = False) -> DataFrame:
    """Counts per (window start, group); rows with NULL ts or group are left out.

    With ``dedupe`` a (ts, group) pair counts once, as in the batch trend (E18). A seen
    pair is kept as state until the watermark passes its time; a copy that comes
    later still is a late row, which no window takes anyway.

    Watermarks need an instant (TIMESTAMP), while the corpus keeps wall-clock
    TIMESTAMP_NTZ, so the event time is taken as UTC (the session time zone
    the library sets) and the window start is returned as TIMESTAMP_NTZ."""
    rows = stream.where(F.col(ts).isNotNull() & F.col(group).isNotNull())
    ntz = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    evt = "_event_time"
    rows = rows.withColumn(evt, F.col(ts).cast("timestamp") if ntz else F.col(ts))
    if watermark:
        rows = rows.withWatermark(evt, watermark)
    if dedupe:
        if not watermark:
            raise ValueError("dedupe needs a watermark, or its state would grow without end")
        rows = rows.dropDuplicatesWithinWatermark([evt, group])
    start = F.col("w.start").cast("timestamp_ntz") if ntz else F.col("w.start")
    return (rows.groupBy(F.window(evt, width).alias("w"), F.col(group).alias("group"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(start.alias("bucket"), "group", "count"))


def run_to_parquet(df: DataFrame, path: str, checkpoint_dir: str) -> DataFrame:
    """Drive a streaming aggregate over the available input into a Parquet
    table that holds the newest count of each window and group.

    In update mode each micro-batch writes the windows it changed under its
    batch id (a retried batch overwrites its own folder). A window's latest batch
    wins on reading, so windows still open at the end of input are there too."""
    from pyspark.sql import Window

    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    (df.writeStream.outputMode("update").option("checkpointLocation", checkpoint_dir)
     .trigger(availableNow=True).foreachBatch(write).start().awaitTermination())
    keys = [f.name for f in schema.fields if f.name != "count"]
    rows = df.sparkSession.read.parquet(path)
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*schema.names)
