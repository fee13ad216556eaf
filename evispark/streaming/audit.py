"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = "event_no bigint, timestamp timestamp, stage string, municipality_id string, url string, status string, cache_hit boolean, usage struct<input_tokens:int,output_tokens:int,total_tokens:int>"


def read_log(spark: SparkSession, folder: str, schema: str = AUDIT_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines that are appended to a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def hourly_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Events and their value by kind and hour; works on batches and, after :func:`with_late_data`, on streams."""
    return events.groupBy(kind, F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(kind, F.col("w.start").alias("hour"), "n", "total")


def with_late_data(events: DataFrame, ts: str, delay: str, key: list[str]) -> DataFrame:
    """Repeated events dropped within the watermark; later ones than ``delay`` are no longer counted."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """Activity of a key parted by pauses: ``key, start, end, n``."""
    return events.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def append(stream: DataFrame, folder: str, checkpoint: str):
    """Write a stream once through to Parquet, exactly once by its checkpoint."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
