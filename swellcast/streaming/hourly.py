"""Streaming hourly mean (A1 on a stream).

Tumbling one-hour event-time windows with a watermark; a window is emitted
once the watermark passes its end (append mode), so late rows within the
watermark still count and state stays bounded. Empty hours have no rows in
a stream; the batch re-index (J1) fills them downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SENTINELS
from ..operators.clean import mark_missing


def hourly_mean_stream(stream: DataFrame, cols: list[str], key: str = "series_id", ts: str = "ts",
                       watermark: str = "2 hours", sentinels: dict | None = None) -> DataFrame:
    """``stream`` of ``(key, ts, *cols)`` -> ``(key, ts, *cols)`` hourly means."""
    x = stream
    if sentinels:
        x = mark_missing(x, {c: v for c, v in sentinels.items() if c in cols})
    x = x.withColumn("_ets", F.col(ts).cast("timestamp")).withWatermark("_ets", watermark)
    g = x.groupBy(key, F.window("_ets", "1 hour").alias("_w")).agg(*[F.avg(c).alias(c) for c in cols])
    return g.select(key, F.col("_w.start").cast("timestamp_ntz").alias(ts), *cols)


def events_stream(spark, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The ``events`` table as a file stream, projected to the ``obs`` view."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger) \
        .option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.select(F.col("event_type").alias("series_id"), "ts", "value")


DEFAULT_SENTINELS = SENTINELS
