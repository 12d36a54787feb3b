"""Structured Streaming forms of the counters, sessions and the ledger (extensions of the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counters(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by user, type and day; rows later than ``late`` are dropped."""
    own = events.withWatermark("ts", late).groupBy("user_id", "event_type", F.window("ts", "1 day").alias("w"))
    return own.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", "event_type", F.col("w.start").alias("day"), "n", "total")


def weekly_trend(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of the last seven days, each day anew."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "7 days", "1 day").alias("w"))
    return own.agg(F.count("*").alias("n")).select("user_id", F.col("w.end").alias("upto"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity of each user that end after ``gap`` of silence."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return own.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_requests(requests: DataFrame, key: str = "source_id", late: str = "2 hours") -> DataFrame:
    """Each request once, as long as its repeats come within ``late``."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
