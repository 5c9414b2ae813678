"""Streaming aggregates over events(user_id, ts, value, ...); each also runs on a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, whose time must bear a zone; a batch table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def counts_by_window(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows."""
    win = F.window("ts", width)
    return (
        _timed(events, late).groupBy(win, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
    )


def sessions_by_gap(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, n) of sessions closed by a gap."""
    win = F.session_window("ts", gap)
    return (
        _timed(events, late).groupBy(win, "user_id").agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
    )


def daily_by_user(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, day, n, low, high) by calendar day."""
    win = F.window("ts", "1 day")
    return (
        _timed(events, late).groupBy(win, "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select("user_id", F.to_date("window.start").alias("day"), "n", "low", "high")
    )


def sliding_days(events: DataFrame, days: int = 5, late: str = "1 day") -> DataFrame:
    """(user_id, last_day, total) of windows of some days that slide by one; named by their last day."""
    win = F.window("ts", f"{days} days", "1 day")
    return (
        _timed(events, late).groupBy(win, "user_id").agg(F.sum("value").alias("total"))
        .select("user_id", F.date_sub(F.to_date("window.end"), 1).alias("last_day"), "total")
    )
