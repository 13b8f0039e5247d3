"""Panels: regular multichannel series from irregular samples, and windows over them.

A panel is long: channel, channel_idx, bin, ts, y, cnt, with a row for every bin of
every channel between its first and last; a bin without samples has a null y and
cnt 0. Windows are cut from arrays of at most BLOCK + width - 1 bins, so a channel
of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import hashing, ranking

BLOCK = 1024


class SealedError(RuntimeError):
    """Data at or after the cut was asked for."""


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def dedupe_keep_last(raw: DataFrame, order: str) -> DataFrame:
    """One sample per (channel, ts): the one that is last by ``order``."""
    return raw.groupBy("channel", "ts").agg(F.max_by("value", order).alias("value"))


def channels(raw: DataFrame) -> DataFrame:
    """(channel, channel_idx) in order of name; one row per channel."""
    return raw.select("channel").distinct().withColumn("channel_idx", (F.row_number().over(Window.orderBy("channel")) - 1).cast("int"))


def mean_bins(raw: DataFrame, bin_seconds: int, cut: str) -> DataFrame:
    """Means and counts of samples (channel, ts, value) before ``cut`` on a dense grid.

    The grid begins at the bin of the earliest sample of any channel; bins that do
    not end by the cut are left out. NaN samples count as missing.
    """
    end = F.lit(cut).cast("timestamp_ntz")
    live = raw.where((F.col("ts") < end) & F.col("value").isNotNull() & ~F.isnan("value"))
    at = F.floor(seconds(F.col("ts")) / bin_seconds)
    binned = live.groupBy("channel", at.alias("g")).agg(F.avg("value").alias("y"), F.count("value").alias("cnt"))
    span = live.agg(F.floor(F.min(seconds(F.col("ts"))) / bin_seconds).alias("g0"))
    last = F.floor(seconds(F.lit(cut).cast("timestamp_ntz")) / bin_seconds) - 1
    # One row of bounds, then one row per channel: both small by nature.
    grid = channels(live).join(F.broadcast(span)).where("g0 IS NOT NULL").select("channel", "channel_idx", "g0", F.explode(F.when(last >= F.col("g0"), F.sequence("g0", last)).otherwise(F.array().cast("array<bigint>"))).alias("g"))
    rows = grid.join(binned, ["channel", "g"], "left")
    ts = F.timestamp_seconds(F.col("g") * bin_seconds).cast("timestamp_ntz")
    return rows.select("channel", "channel_idx", (F.col("g") - F.col("g0")).alias("bin"), ts.alias("ts"), "y", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def slice_channels(panel: DataFrame, keep: list[str]) -> DataFrame:
    """The named channels, numbered in the given order; a missing one is an error."""
    present = {r["channel"] for r in panel.where(F.col("channel").isin(keep)).select("channel").distinct().collect()}
    if missing := [c for c in keep if c not in present]:
        raise KeyError(f"channels not in the panel: {missing}")
    index = F.element_at(F.create_map(*[x for i, c in enumerate(keep) for x in (F.lit(c), F.lit(i))]), F.col("channel"))
    return panel.where(F.col("channel").isin(keep)).withColumn("channel_idx", index)


def crop(panel: DataFrame, cut: str) -> DataFrame:
    return panel.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))


def assert_sealed(windows: DataFrame, width: int, cut_bin: int) -> None:
    """Raise if a window's last bin is at or after the cut."""
    if not windows.where(F.col("start") + width - 1 >= cut_bin).isEmpty():
        raise SealedError("a window reaches the sealed span")


def bin_index(ts: Column, t0: Column, bin_seconds: int, n_bins: int, side: str = "left") -> Column:
    """Where a time falls in the grid: the first bin at or after it (left) or the first after it (right), in 0 to n_bins."""
    at = (seconds(ts) - seconds(t0)) / bin_seconds
    i = F.ceil(at) if side == "left" else F.floor(at) + 1
    return F.greatest(F.lit(0), F.least(F.lit(n_bins), i)).cast("int")


def windows(panel: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(channel, channel_idx, start, x): every window of ``width`` bins that all have values."""
    b = F.floor(F.col("bin") / block)
    both = F.when((F.col("bin") % block < width - 1) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))
    parts = panel.select("channel", "channel_idx", "bin", F.when((F.col("cnt") > 0) & ~F.isnan("y"), F.col("y")).alias("y"), F.explode(both).alias("block"))
    rows = parts.groupBy("channel", "channel_idx", "block").agg(F.array_sort(F.collect_list(F.struct("bin", "y"))).alias("v"))
    starts = F.filter(F.transform("v", lambda _, i: i), lambda i: (i < block) & (i + width <= F.size("v")))
    cut = rows.select("channel", "channel_idx", F.col("v.bin").alias("bins"), F.col("v.y").alias("ys"), F.explode(starts).alias("i"))
    out = cut.select("channel", "channel_idx", F.element_at("bins", F.col("i") + 1).alias("start"), F.slice("ys", F.col("i") + 1, width).alias("x"))
    return out.where(~F.exists("x", lambda v: v.isNull()))


def window_report(panel: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """Per channel: share of finite bins, finite windows, std and range of values, share of distinct values in windows."""
    per = panel.groupBy("channel").agg(F.avg((F.col("cnt") > 0).cast("double")).alias("finite_frac"), F.stddev_pop("y").alias("std"), (F.max("y") - F.min("y")).alias("ptp"))
    w = windows(panel, width, block).groupBy("channel").agg(F.count("*").alias("n_windows"), F.avg(F.size(F.array_distinct(F.transform("x", lambda v: F.round(v, 6)))) / width).alias("unique_frac"))
    return per.join(w, "channel", "left").select("channel", "finite_frac", "std", "ptp", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("unique_frac", F.lit(0.0)).alias("unique_frac"))


def snap_report(panel: DataFrame, width: int, n_probe: int = 48, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Per channel: n_probe, median_unique_per_win and mean_snap of probed windows, n_unique_all of finite bins.

    Probes are ``n_probe`` finite windows by keyed hash (all, if fewer). A window of at most
    32 distinct values (to six places) snaps where a value is within a quarter of the
    smallest gap of its nearest distinct value; with more of them nothing snaps.
    """
    r6 = lambda v: F.round(v, 6)
    w = windows(panel, width, block).withColumn("h", hashing.hashed(seed, F.col("channel_idx"), F.col("start")))
    probes = ranking.numbered(w, ["channel"], ranking.hash_bucket(F.col("h")), ["h", "start"]).where(F.col("index") < n_probe)
    u = F.array_sort(F.array_distinct(F.transform("x", r6)))
    gap = lambda u: F.when(F.size(u) > 1, F.array_min(F.zip_with(F.slice(u, 2, F.size(u) - 1), F.slice(u, 1, F.size(u) - 1), lambda b, a: b - a))).otherwise(1e-6)
    near = lambda u, room: F.size(F.filter("x", lambda v: F.array_min(F.transform(u, lambda k: F.abs(v - k))) <= room)) / width
    snap = A.let(u, lambda u: F.when(F.size(u) <= 32, A.let(0.25 * F.greatest(gap(u), F.lit(1e-9)), lambda room: near(u, room))).otherwise(0.0))
    each = probes.select("channel", F.size(u).alias("k"), snap.alias("snap"))
    # At most ``n_probe`` rows a channel.
    probed = each.groupBy("channel").agg(F.count("*").alias("n_probe"), F.percentile("k", F.lit(0.5)).alias("median_unique_per_win"), F.avg("snap").alias("mean_snap"))
    every = panel.groupBy("channel").agg(F.count_distinct(F.when((F.col("cnt") > 0) & ~F.isnan("y"), r6("y"))).alias("n_unique_all"))
    return every.join(probed, "channel", "left").select("channel", F.coalesce("n_probe", F.lit(0)).alias("n_probe"), F.coalesce("median_unique_per_win", F.lit(0.0)).alias("median_unique_per_win"), F.coalesce("mean_snap", F.lit(0.0)).alias("mean_snap"), "n_unique_all")
