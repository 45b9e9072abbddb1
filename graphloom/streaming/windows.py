"""Event-time windows, the same expression over a table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """events with the time as a timestamp with zone, which watermarks need."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def _counts() -> list[Column]:
    return [F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value")]


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, event_type, events, value per window and type; late: how long a stream waits for late rows."""
    e = timed(events) if late is None else timed(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "event_type").agg(*_counts()).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sliding(events: DataFrame, size: str = "1 day", every: str = "6 hours", late: str | None = None) -> DataFrame:
    e = timed(events) if late is None else timed(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size, every)).agg(*_counts()).select(F.col("window.start").alias("start"), "events", "value")


def sessions(events: DataFrame, idle: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, end, events, value: a user's events with no silence of `idle` or longer between them."""
    e = timed(events) if late is None else timed(events).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", idle)).agg(*_counts()).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "value")
