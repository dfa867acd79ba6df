"""Event-time windows, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def tumbling(events: DataFrame, length: str = "1 hour", every: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of windows of a length, sliding if every is given; rows later than late are dropped
    from streams."""
    w = F.window("ts", length, every or length)
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, n, total) of a user's sessions, which a gap ends."""
    w = F.session_window("ts", gap)
    return _timed(events, late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")
