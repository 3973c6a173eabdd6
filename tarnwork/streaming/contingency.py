"""Counts and first deliveries over streams.

Streaming twins of two batch operators: the two-by-two counts of units and
reactions per time window, and the first delivery of each report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, time: str) -> DataFrame:
    """Watermarks take timestamps of the session's zone only."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, unit: str, reaction: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, unit, reaction, n) per tumbling window; later rows than ``late`` are dropped by the watermark."""
    w = _timed(events, time).withWatermark(time, late).groupBy(F.window(time, window), unit, reaction).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), unit, reaction, "n")


def first_deliveries(reports: DataFrame, key: str, time: str, late: str = "3 days") -> DataFrame:
    """Rows whose key was not delivered before within the watermark."""
    return _timed(reports, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time: str, unit: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(unit, start, end, n) per session of a unit, closed by a gap."""
    s = _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), unit).agg(F.count("*").alias("n"))
    return s.select(unit, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
