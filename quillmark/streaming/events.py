"""Streams of events and files: hourly windows with a watermark, and files taken in as they come. An extension: the batch forms give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame, late: str | None) -> DataFrame:
    """events with a watermark, which needs a time with a zone; without `late` as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def windowed(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n, value; with `late` events may come so much later and state behind that is dropped."""
    x = timed(events, late)
    g = x.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, end, n of stretches without a gap."""
    x = timed(events, late)
    g = x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def ingest(spark: SparkSession, path: str, schema: str, to: str, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Takes in Parquet files that came since the last run and ends; the checkpoint is the cursor."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return s.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
