"""Structured Streaming extension over event tables: windows with watermarks, de-duplication, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _late(events: DataFrame, late: str | None) -> DataFrame:
    """Watermark on streams; event times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late and events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Count and sum per window and type; the same plan for batch and stream (watermark on streams)."""
    src = _late(events, late)
    g = src.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str | None = "10 minutes") -> DataFrame:
    src = _late(events, late)
    g = src.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    src = _late(events, late)
    g = src.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row per event_id."""
    return _late(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write Parquet, stop; restarts go on from the checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
