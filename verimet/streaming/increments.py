"""Streaming forms of the hourly job.

Bins are the same built-in windows as in batch, closed by a watermark; sinks
are keyed by batch id, so a restarted query writes each batch once.  Event time
must be TIMESTAMP for a watermark, so naive UTC is cast on the way in and back
on the way out (the session runs in UTC).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verimet.sources.sinks import append_batch


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _event_time(stream: DataFrame, ts: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def hourly_wind(stream: DataFrame, hours: int = 1, ts: str = "time_5M", delay: str = "2 hours", station: str = "station") -> DataFrame:
    """Mean wind, mean temperature and row count per station and left-labelled bin."""
    return (
        _event_time(stream, ts).withWatermark(ts, delay)
        .groupBy(station, F.window(ts, f"{hours} hours").alias("_w"))
        .agg(F.avg("wspd_sonic").alias("wspd_sonic_mean"), F.avg("tair").alias("tair"), F.count(F.lit(1)).alias("n"))
        .select(station, F.col("_w.start").cast("timestamp_ntz").alias("valid_time"), "wspd_sonic_mean", "tair", "n")
    )


def without_repeats(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "2 hours") -> DataFrame:
    """Drop repeated deliveries of a row that arrive within the watermark."""
    return (
        _event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
        .withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    )


def append_closed_bins(stream: DataFrame, path: str, checkpoint: str):
    """Write finished bins; ends when the input present at start is used up."""
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write every micro-batch under its id; `sinks.read_latest` gives the merged table."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: append_batch(batch, path, batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
