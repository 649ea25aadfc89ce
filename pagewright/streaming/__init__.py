"""Bounded-state stream checks: progress must not fall, by key, within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def progress_breaks(events: DataFrame) -> DataFrame:
    """Batch form: rows whose value is below an earlier one of their key."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    top = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("top", top).where(F.col("value") < F.col("top")).groupBy("user_id").agg(F.count("*").alias("n_breaks"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Streaming form of a page report: counts of each kind in event-time windows, bounded by a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
