"""Structured Streaming over event streams. Each operator has a batch twin that gives the same rows over all the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A replay of parquet files; times become TIMESTAMP, as watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def counters(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Calls and value of each kind of event by tumbling window; works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total")).select(
        F.col("w.start").cast("string").alias("start"), "event_type", "calls", "total")


def bursts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """A user's events in sessions that a silence of ``gap`` ends: first time, events."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events")).select("user_id", F.col("s.start").cast("string").alias("start"), "events")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events whose event_id is new within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
