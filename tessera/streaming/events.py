"""Event-time windows over event streams: watermark, tumbling and session windows.

State is one row of aggregates per open window and key; the watermark closes windows
and bounds it. Rows behind the watermark are left out and counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def _measures(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"), F.max(value).alias("largest")]


def tumbling_windows(events: DataFrame, width: str, delay: str, keys: Sequence[str] = (), time: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, window_end, *keys, events, total, largest) per window and key;
    rows may be up to ``delay`` late."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(*_measures(value))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events", "total", "largest")


def session_windows(events: DataFrame, gap: str, delay: str, keys: Sequence[str], time: str = "ts", value: str = "value") -> DataFrame:
    """The same per run of rows of a key with less than ``gap`` between them. As a
    stream only closed sessions come out (append mode)."""
    counted = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*_measures(value))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "events", "total", "largest")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators left out behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
