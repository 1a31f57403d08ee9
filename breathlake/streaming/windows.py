"""Sliding windows over a stream of readings: the batch operator's shape with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_windows(readings: DataFrame, by: str, time: str, value: str, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Moments of each key and sliding event-time window; rows later than ``late`` are dropped.

    Works on a stream and, with the same result but for windows still open, on
    a table. A time without zone is read as UTC.
    """
    r = readings.withColumn(time, F.col(time).cast("timestamp"))
    if r.isStreaming:
        r = r.withWatermark(time, late)
    g = r.groupBy(F.col(by), F.window(time, size, slide))
    return g.agg(F.count(value).alias("n"), F.avg(value).alias("mean_x"), F.min(value).alias("min_x"), F.max(value).alias("max_x")).select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean_x", "min_x", "max_x")
