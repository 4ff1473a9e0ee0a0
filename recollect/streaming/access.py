"""Streaming access state: per-node counts in event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(node_id, start, accesses, last): works on a stream and on a batch alike; later rows than ``late`` are dropped on a stream."""
    e = events.select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "node_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last")).select("node_id", F.col("window.start").alias("start"), "accesses", "last")


def sessions(messages: DataFrame, gap: str = "24 hours") -> DataFrame:
    """(node_id, start, n): activity sessions that end after ``gap`` without an event."""
    m = messages.select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"))
    if messages.isStreaming:
        m = m.withWatermark("ts", "1 hour")
    return m.groupBy(F.session_window("ts", gap), "node_id").agg(F.count("*").alias("n")).select("node_id", F.col("session_window.start").alias("start"), "n")
