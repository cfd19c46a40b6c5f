"""Interval operators on event streams: tumbling tiles, sliding windows and merged sessions.

They work on batch and streaming frames alike; on a stream the watermark bounds the state, and rows later than it
are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _windowed(df: DataFrame, ts: str, late: str, by: list[str], window) -> DataFrame:
    d = df.withWatermark(ts, late) if df.isStreaming else df
    g = d.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")


def tile_stream(df: DataFrame, ts: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts over fixed tiles of time."""
    return _windowed(df, ts, late, by, F.window(ts, width))


def sliding_stream(df: DataFrame, ts: str, width: str, step: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts over overlapping windows of time."""
    return _windowed(df, ts, late, by, F.window(ts, width, step))


def session_stream(df: DataFrame, ts: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Merged runs of events whose gaps stay below a limit: interval merge on a stream."""
    return _windowed(df, ts, late, by, F.session_window(ts, gap))
