"""Session summaries on a stream of log events: explicit sessions, or gaps of inactivity, with late events bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_summary(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """user_id, started, ended, n: sessions end after a gap without events. For batch frames the watermark has no effect."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).select("user_id", "started", "ended", "n")
    )
