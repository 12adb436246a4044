"""Extension: event means per window and type as a stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_means(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, mean) per tumbling window; works on batch and streaming tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = timed.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    means = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return means.select(F.col("window.start").alias("start"), "event_type", "n", "mean")
