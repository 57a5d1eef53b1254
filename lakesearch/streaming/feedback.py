"""Feedback streams: counters free of duplicates, and rates over time windows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(events: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Usage, success and failure counts per experience.

    A repeated event id is dropped when it comes within ``horizon`` of the first
    one; the horizon bounds the state kept for it.
    """
    once = events.withWatermark("occurred_at", horizon).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("experience_id").agg(
        F.count("*").alias("usage_count"), F.count_if(F.col("outcome") == "success").alias("success_count"), F.count_if(F.col("outcome") == "failure").alias("failure_count"),
    )


def windowed_rates(events: DataFrame, key: str, size: str = "1 hour", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """Event count and share of failures per key and tumbling or sliding window."""
    span = F.window("occurred_at", size, slide) if slide else F.window("occurred_at", size)
    failed = F.count_if(F.col("outcome") == "failure")
    return events.withWatermark("occurred_at", lateness).groupBy(span.alias("w"), key).agg(
        F.count("*").alias("events"), failed.alias("failures"), (failed / F.count("*")).alias("failure_rate"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "events", "failures", "failure_rate")
