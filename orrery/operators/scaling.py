"""Channel scalers: lowest and highest training value of each channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SPAN = 1e-6


def fit_minmax(windows: DataFrame, dim: DataFrame) -> DataFrame:
    """(channel_idx, lo, hi) for every channel of ``dim``; one without windows has 0 and 1."""
    seen = windows.groupBy("channel_idx").agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi"))
    return dim.select("channel_idx").join(seen, "channel_idx", "left").select("channel_idx", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))


def _span() -> Column:
    return F.greatest(F.col("hi") - F.col("lo"), F.lit(LEAST_SPAN))


def transform(windows: DataFrame, scaler: DataFrame, to: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Windows mapped to a range, without clipping."""
    a, b = to
    return windows.join(scaler, "channel_idx").withColumn("s", _span()).withColumn("x", F.transform("x", lambda v: a + (v - F.col("lo")) / F.col("s") * (b - a))).drop("lo", "hi", "s")


def inverse(windows: DataFrame, scaler: DataFrame, to: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    a, b = to
    return windows.join(scaler, "channel_idx").withColumn("s", _span()).withColumn("x", F.transform("x", lambda v: (v - a) / (b - a) * F.col("s") + F.col("lo"))).drop("lo", "hi", "s")


def span_normalise(windows: DataFrame, scaler: DataFrame) -> DataFrame:
    """Windows in units of their channel's range."""
    return windows.join(scaler, "channel_idx").withColumn("s", F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))).withColumn("x", F.transform("x", lambda v: (v - F.col("lo")) / F.col("s"))).drop("lo", "hi", "s")


def envelope(windows: DataFrame, scaler: DataFrame) -> DataFrame:
    """Share of values outside the range, whether any is, and the largest excess."""
    u = span_normalise(windows, scaler)
    n = F.size(F.filter("x", lambda v: (v < 0) | (v > 1)))
    excess = F.array_max(F.transform("x", lambda v: F.greatest(-v, v - 1, F.lit(0.0))))
    return u.withColumns({"outside_frac": n / F.size("x"), "any_outside": n > 0, "excess": excess})
