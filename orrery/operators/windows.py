"""Placement of labelled windows, sampling of nominal ones, and the training pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import hashing
from orrery.operators import panel as P


def even_starts(lo: Column, hi: Column, width: int, most: int) -> Column:
    """Starts of at most ``most`` crops of a span, edge to edge or evenly spread (halves go to even)."""
    n = 1 + F.floor((hi - lo - width) / width)
    packed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (lo + i * width).cast("int"))
    if most == 1:
        spread = F.array(lo.cast("int"))
    else:
        spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(lo + i * ((hi - lo - width) / (most - 1))).cast("int"))
    return F.when(hi - lo < width, F.array().cast("array<int>")).when(n <= most, packed).otherwise(spread)


def label_bins(pairs: DataFrame, t0: str, bin_seconds: int, n_bins: int) -> DataFrame:
    """``pairs`` with label_lo and label_hi, the half-open span in bins (one bin at least)."""
    first = F.lit(t0).cast("timestamp_ntz")
    lo = P.bin_index(F.col("start"), first, bin_seconds, n_bins, "left")
    hi = P.bin_index(F.col("end"), first, bin_seconds, n_bins, "right")
    rows = pairs.withColumns({"label_lo": lo, "hi": hi})
    return rows.withColumn("label_hi", F.when(F.col("hi") <= F.col("label_lo"), F.least(F.lit(n_bins), F.col("label_lo") + 1)).otherwise(F.col("hi"))).drop("hi")


def labeled_windows(pairs: DataFrame, finite: DataFrame, width: int, most: int, n_bins: int, cut_bin: int) -> DataFrame:
    """Windows of labelled spans: crops of long ones, short ones centred; whole, finite and before the cut.

    ``pairs`` has label_lo and label_hi, ``finite`` the windows (channel_idx, start, x).
    """
    lo, hi = F.col("label_lo"), F.col("label_hi")
    centre = F.greatest(F.lit(0), F.least(F.floor((lo + hi) / 2) - width // 2, F.lit(n_bins - width))).cast("int")
    long = hi - lo >= width
    starts = F.when(long, even_starts(lo, hi, width, most)).otherwise(F.array(centre))
    rows = pairs.where(~F.col("in_test_pool")).withColumns({"placement": F.when(long, "crop").otherwise("center"), "at": F.explode(starts)})
    rows = rows.where((F.col("at") >= 0) & (F.col("at") + width <= min(n_bins, cut_bin)))
    kind = F.when(F.col("is_anomaly"), "anomaly").when(F.col("is_rare"), "rare").otherwise("other")
    f = finite.select("channel_idx", F.col("start").cast("int").alias("at"), "x")
    return rows.drop("start", "end").join(f, ["channel_idx", "at"]).withColumn("kind", kind).withColumnRenamed("at", "start")


def nominal_sample(finite: DataFrame, occupied: DataFrame, width: int, per_channel: int, cut_bin: int, seed: int) -> DataFrame:
    """At most ``per_channel`` windows of each channel that touch no occupied bin, by keyed hash."""
    touched = occupied.select("channel_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - width + 1).cast("bigint"), F.col("bin").cast("bigint"))).alias("start")).distinct()
    free = finite.where(F.col("start") + width <= cut_bin).join(touched, ["channel_idx", "start"], "left_anti")
    order = Window.partitionBy("channel_idx").orderBy(hashing.hashed(seed, F.col("channel_idx"), F.col("start")), "start")
    # A rank bound lets Spark keep only the first rows of each task before the shuffle.
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_channel).drop("rank")


def train_pool(nominal: DataFrame, rare: DataFrame, upsample: int = 1) -> DataFrame:
    """Nominal windows and rare ones, each of those ``upsample`` times; never anomalies."""
    rare = rare.where("is_rare AND NOT is_anomaly").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(upsample))))
    return nominal.withColumn("pool", F.lit("nominal")).unionByName(rare.withColumn("pool", F.lit("rare")), allowMissingColumns=True)
