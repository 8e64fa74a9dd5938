"""Degrees of a growing bipartite graph in event-time windows.

The batch engine has no streams of its own; this carries ``degrees`` over to Structured Streaming,
with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, time: str = "ts", end: str = "dst", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, end, deg of a batch or a stream of edges with a time column."""
    counted = edges.withWatermark(time, late).groupBy(F.window(time, width), end).agg(F.count("*").alias("deg"))
    return counted.select(F.col("window.start").alias("window_start"), end, "deg")
