"""The panel's bins over a stream: the sparse part of the batch operator, with late samples bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_bins(raw: DataFrame, bin_seconds: int, late: str = "1 hour") -> DataFrame:
    """(channel, ts, y, cnt) of closed bins; ``raw`` is a stream of (channel, ts, value) with naive UTC times."""
    at = raw.withColumn("at", F.col("ts").cast("timestamp")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    w = at.withWatermark("at", late).groupBy("channel", F.window("at", f"{bin_seconds} seconds").alias("w")).agg(F.avg("value").alias("y"), F.count("value").alias("cnt"))
    return w.select("channel", F.col("w.start").cast("timestamp_ntz").alias("ts"), "y", "cnt")
