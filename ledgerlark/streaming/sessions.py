"""Streaming forms of the session and first-occurrence operators, for event tables that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, at: str, user: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events and first and last time of each user's sessions; batch or streaming."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    grouped = marked.groupBy(user, F.session_window(at, gap).alias("session"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).drop("session")


def first_events(events: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Events whose key hasn't been seen within the watermark."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
