"""Tables that a report is made of: slices, counts, diagnostics, distributions, picks and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import hashing, ranking, shared


def slice_metrics(rows: DataFrame, by: str = "kind_alloc", amp: float = 0.1, shift: float = 0.01) -> DataFrame:
    """Per slice of windows (x): how many, what share reaches an amplitude and a level shift, and the medians of both."""
    s = shared.written(rows.select(by, A.amplitude(F.col("x")).alias("amp"), A.level_shift(F.col("x")).alias("dmu")), "slices")
    share = lambda c, least: F.avg((F.col(c) >= least).cast("double"))
    g = s.groupBy(by).agg(F.count("*").alias("n"), share("amp", amp).alias("amp_rate"), share("dmu", shift).alias("shift_rate"))
    return ranking.with_medians(g, s, [by], amp_median="amp", shift_median="dmu")


def spectrum_slices(rows: DataFrame, by: str = "kind_alloc", bands: str = "bands") -> DataFrame:
    """Per slice: the median ratio of high to low frequency energy, from log-bands."""
    s = shared.written(rows.select(by, A.hf_lf(F.col(bands)).alias("r")), "slices")
    return ranking.with_medians(s.groupBy(by).agg(F.count("*").alias("n")), s, [by], hf_lf_median="r")


def kind_hits(rows: DataFrame, amp: float = 0.1, shift: float = 0.01) -> DataFrame:
    """One row over a gallery: shares of windows with a shift, with an amplitude and no shift, and with neither."""
    a, d = A.amplitude(F.col("x")) >= amp, A.level_shift(F.col("x")) >= shift
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), share(d).alias("shift_frac"), share(a & ~d).alias("spike_frac"), share(~a & ~d).alias("subtle_frac"))


def coverage_by_slice(near: DataFrame, tau: float, by: str = "kind_name") -> DataFrame:
    """Per kind of query: coverage within tau, ARP and how many, from nearest distances (by, distance)."""
    d = F.col("distance")
    return near.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.avg((d <= tau).cast("double")), F.lit(0.0)).alias("coverage"), F.coalesce(1 / (1 + F.avg(F.when(F.abs(d) != float("inf"), d))), F.lit(0.0)).alias("arp"))


def diagnostics(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, n, mean, median, p05, p95) of each metric's values that are neither null nor NaN; a null group has null quantiles."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = shared.written(rows.select(*by, F.inline(pairs)).where(F.col("v").isNotNull() & ~F.isnan("v")), "metrics")
    key = [*by, "metric"]
    q = ranking.quantiles(long, "v", [0.05, 0.5, 0.95], key).select(*key, "q")
    g = long.groupBy(*key).agg(F.count("*").alias("n"), F.avg("v").alias("mean")).join(q, key, "left")
    return g.select(*key, "n", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p05"), F.col("q")[2].alias("p95"))


def ecdf(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, share): the share of values up to each distinct one, step at ties; running sums by buckets of values."""
    n = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    return ranking.below(n, [by], value, ["c"]).select(by, value, ((F.col("c_below") + F.col("c")) / F.col("c_total")).alias("share"))


def channel_totals(labeled: DataFrame, nominal: DataFrame, channels: DataFrame, least: int = 5) -> DataFrame:
    """(channel, n_anomaly, n_rare, n_nominal, few) of every channel, zeros too; fewer than ``least`` anomalies are few."""
    a = labeled.groupBy("channel").agg(F.count_if("is_anomaly").alias("n_anomaly"), F.count_if("is_rare").alias("n_rare"))
    b = nominal.groupBy("channel").agg(F.count("*").alias("n_nominal"))
    rows = channels.select("channel").join(a, "channel", "left").join(b, "channel", "left").na.fill(0, ["n_anomaly", "n_rare", "n_nominal"])
    return rows.withColumn("few", F.col("n_anomaly") < least)


def counts(rows: DataFrame, by: str, every: DataFrame | None = None) -> DataFrame:
    """(by, n); with ``every`` (by), those that do not occur count 0."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n if every is None else every.select(by).join(n, by, "left").na.fill(0, ["n"])


def reference_counts(rows: DataFrame, fold: int, most: int) -> DataFrame:
    """Per kind: all windows, those of other folds, references taken (at most ``most``) and whether they leak (no other fold has any)."""
    g = rows.groupBy("kind_name").agg(F.count("*").alias("n_all"), F.count_if(F.col("fold") != fold).alias("n_oof"))
    leaked = F.col("n_oof") == 0
    return g.select("kind_name", "n_all", "n_oof", F.least(F.lit(most), F.when(leaked, F.col("n_all")).otherwise(F.col("n_oof"))).alias("n_ref"), leaked.alias("leaked"))


def fold_scores(near: DataFrame, keep: DataFrame, tau: float) -> DataFrame:
    """(fold, n, coverage, arp, unfiltered): scores of each fold over the channels that keep enough anomalies there.

    ``near`` has channel, fold, distance; ``keep`` the (channel, fold) that are kept. A fold
    of which nothing is kept is scored whole and marked ``unfiltered``.
    """
    marked = near.join(keep.select("channel", "fold", F.lit(True).alias("kept")), ["channel", "fold"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    some = marked.groupBy("fold").agg(F.bool_or("kept").alias("some"))
    live = marked.join(some, "fold").where(F.col("kept") | ~F.col("some"))
    d = F.col("distance")
    g = live.groupBy("fold").agg(F.count("*").alias("n"), F.avg((d <= tau).cast("double")).alias("coverage"), (1 / (1 + F.avg(F.when(F.abs(d) != float("inf"), d)))).alias("arp"), F.bool_and(~F.col("some")).alias("unfiltered"))
    return g.withColumn("arp", F.coalesce("arp", F.lit(0.0)))


def metric_lookup(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values of (run, key) asked for, in (run, key, value); null where there is none."""
    return wanted.join(rows.groupBy("run", "key").agg(F.max("value").alias("value")), ["run", "key"], "left")


def pick_extreme(rows: DataFrame, n: int, ties: str = "donor_id") -> DataFrame:
    """The ``n`` windows of largest range."""
    return rows.orderBy(F.round(A.amplitude(F.col("x")), 9).desc(), ties).limit(n)


def pick_mixed(rows: DataFrame, n: int, seed: int = 0, ties: str = "donor_id") -> DataFrame:
    """Half of largest range (``extreme`` true), the rest by keyed hash from the others."""
    first = pick_extreme(rows, n // 2, ties)
    rest = rows.join(first.select(ties), ties, "left_anti").orderBy(hashing.hashed(seed, F.col(ties)), ties).limit(n - n // 2)
    return first.withColumn("extreme", F.lit(True)).unionByName(rest.withColumn("extreme", F.lit(False)))


def one_per_channel(rows: DataFrame, most: int, ties: str = "donor_id") -> DataFrame:
    """The first window of each channel, of at most ``most`` channels."""
    first = rows.groupBy("channel_idx").agg(F.min(ties).alias(ties))
    return first.orderBy("channel_idx").limit(most)


def subsample(rows: DataFrame, n: int, seed: int = 0, ties: str = "donor_id") -> DataFrame:
    """``n`` rows without replacement, by keyed hash."""
    return rows.orderBy(hashing.hashed(seed, F.col(ties)), ties).limit(n)


def balanced_batch(rows: DataFrame, by: str, per_class: int, seed: int = 0, ties: str = "donor_id") -> DataFrame:
    """``per_class`` rows of each class by keyed hash; a smaller class gives what it has."""
    h = rows.withColumn("h", hashing.hashed(seed, F.col(ties)))
    spot = ranking.numbered(h, [by], ranking.hash_bucket(F.col("h")), ["h", ties])
    return spot.where(F.col("index") < per_class).drop("h", "index", "n")


def slice_strength(kind: Column, proto_kinds: list[str], default: float) -> Column:
    """Struct (proto, lam): kinds with a prototype are pulled to it with full strength, others as by default."""
    proto = kind.isin(proto_kinds)
    return F.struct(proto.alias("proto"), F.when(proto, 1.0).otherwise(default).alias("lam"))


def rank_encoders(rows: DataFrame) -> DataFrame:
    """(encoder, auroc_ar, auroc_an, rank): by anomaly against rare first, then anomaly against nominal."""
    order = Window.orderBy(F.col("auroc_ar").desc_nulls_last(), F.col("auroc_an").desc_nulls_last(), "encoder")  # one row for an encoder
    return rows.withColumn("rank", F.row_number().over(order))


def finite_gate(rows: DataFrame, most: float = 50.0) -> DataFrame:
    """(cell, n, finite, explode): is every value of a cell's windows finite, and does any exceed ``most`` in size?"""
    size = F.transform("x", F.abs)
    ok = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.bool_and(ok).alias("finite"), F.bool_or(ok & (F.array_max(size) > most)).alias("explode"))


def scout(stats: DataFrame, channels: DataFrame, labels: DataFrame) -> DataFrame:
    """Channel statistics with what is known of the channels and their labels; unknown ones get defaults."""
    rows = stats.join(channels, "channel", "left").join(labels.withColumnRenamed("Channel", "channel"), "channel", "left")
    return rows.na.fill(0, ["n_events", "n_anomaly", "n_rare"]).na.fill("", ["kind", "group"]).withColumn("target", F.coalesce("target", F.lit(False)))


def candidates(scouted: DataFrame, used: list[str], groups: list[str], least: int = 3) -> DataFrame:
    """Analog target channels that are not used yet and have enough events, or are in one of the groups."""
    return scouted.where((F.col("kind") == "analog") & F.col("target") & ~F.col("channel").isin(used) & ((F.col("n_anomaly") >= least) | F.col("group").isin(groups)))
