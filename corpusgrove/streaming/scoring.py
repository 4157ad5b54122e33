"""Streaming scoring of new texts against a trained bundle.

The per-row work (encode, reduce, nearest centroids) is stateless. Each
micro-batch is scored with the batch plan inside ``foreachBatch`` and appended
to a Parquet sink. The sink
write is idempotent per batch id (overwrite of ``batch_id=<id>``), so a
restarted query after a lost executor or driver never duplicates rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import pipeline
from ..sources.bundle import Bundle


def score_stream(stream: DataFrame, bundle: Bundle, sink_dir: str, checkpoint_dir: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Start the scoring query; ``stream`` has ``row_id`` and ``text`` (or
    ``embedding``)."""
    pipeline.require_trained(bundle)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = pipeline.read_scored_columns(pipeline.score(bundle, batch, checked=True))
        (scored.write.mode("overwrite")
         .parquet(os.path.join(sink_dir, f"batch_id={batch_id}")))

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)
