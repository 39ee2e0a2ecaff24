"""Streaming form of blocking: calls that arrive in time order are grouped by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_chunks(events: DataFrame, ts: str, key: str, gap: str = "1000 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of rows of one key without a gap in time: session windows under a watermark, for batches and streams."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.session_window(ts, gap)
    return events.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
