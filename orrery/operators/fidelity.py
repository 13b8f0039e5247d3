"""How alike generated and real windows are distributed.

``real`` and ``synth`` have channel_idx and x in units of the channel's range. A
channel that one side lacks does not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import hashing, ranking, shared, spectral
from orrery.operators import grouped

EPS = 1e-12
FEATURES = ("mean", "std", "trend", "skew", "kurtosis", "acf1")


def both(real: DataFrame, synth: DataFrame, *cols: str) -> DataFrame:
    """The two sides below each other, with ``real`` true or false."""
    return real.select(F.lit(True).alias("real"), *cols).unionByName(synth.select(F.lit(False).alias("real"), *cols))


def wasserstein(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, w1) of values (by, real, v): the area between the two empirical distribution functions.

    Values are counted first; running sums are taken within buckets of values that follow
    their quantiles, so no group is sorted in one task. With one value more, the sum of
    |F - G| over steps is a difference of neighbours: each value carries the step up to it
    and the step after it, so no next value is looked up.
    """
    counts = rows.groupBy(*by, "v").agg(F.count_if("real").alias("r"), F.count_if(~F.col("real")).alias("s"))
    at = ranking.below(counts, by, "v", ["r", "s"]).where("r_total > 0 AND s_total > 0")
    gap = lambda more: F.abs((F.col("r_below") + F.col("r") * more) / F.col("r_total") - (F.col("s_below") + F.col("s") * more) / F.col("s_total"))
    # v[i] ends the step whose height is that below it and begins the one above it.
    return at.groupBy(*by).agg(F.sum(F.col("v") * (gap(0) - gap(1))).alias("w1")).select(*by, F.greatest("w1", F.lit(0.0)).alias("w1"))


def marginal_w1(real: DataFrame, synth: DataFrame) -> DataFrame:
    return wasserstein(both(real, synth, "channel_idx", F.explode("x").alias("v")), ["channel_idx"])


def marginal_difference(real: DataFrame, synth: DataFrame, bins: int = 50, skip_first: bool = True) -> DataFrame:
    """Per channel: mean absolute difference of histogram densities on the real range of each time step, and the share outside it."""
    rows = both(real, synth, "channel_idx", F.posexplode("x").alias("t", "v"))
    rows = rows.where(F.col("t") >= 1) if skip_first else rows
    key = ["channel_idx", "t"]
    span = rows.groupBy(*key).agg(F.min(F.when(F.col("real"), F.col("v"))).alias("lo"), F.max(F.when(F.col("real"), F.col("v"))).alias("hi"), F.count_if("real").alias("nr"), F.count_if(~F.col("real")).alias("ns"))
    span = span.where("nr > 0 AND ns > 0").withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1e-5).otherwise(F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    b = F.when(inside, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)))
    counts = rows.join(span, key).withColumn("b", b).groupBy(*key, "b", "nr", "ns", width.alias("w")).agg(F.count_if("real").alias("r"), F.count_if(~F.col("real")).alias("s"))
    diff = F.when(F.col("b").isNotNull(), F.abs(F.col("r") / F.col("nr") - F.col("s") / F.col("ns")) / F.col("w")).otherwise(0.0)
    out = F.when(F.col("b").isNull(), F.col("s") / F.col("ns")).otherwise(0.0)
    steps = counts.groupBy(*key).agg((F.sum(diff) / bins).alias("d"), F.sum(out).alias("o"))
    return steps.groupBy("channel_idx").agg(F.avg("d").alias("mdd"), F.avg("o").alias("outside_frac"))


def pooled_acf(rows: DataFrame, lags: int, by: list[str]) -> DataFrame:
    """(by, lag, acf) with one mean and variance for all windows of a group."""
    n = F.size("x").cast("double")
    stats = rows.groupBy(*by).agg((F.sum(A.total(F.col("x"))) / F.sum(n)).alias("m"))
    centred = rows.join(stats, by).withColumn("x", F.transform("x", lambda v: v - F.col("m")))
    var = F.sum(A.total(F.transform("x", lambda v: v * v))) / F.sum(n)
    cols = []
    for k in range(1, lags):
        prod = A.total(F.zip_with(F.slice("x", k + 1, F.size("x") - k), F.slice("x", 1, F.size("x") - k), lambda a, b: a * b))
        cols.append((F.sum(prod) / F.sum(n - k)).alias(f"k{k}"))
    one = centred.groupBy(*by).agg(var.alias("var"), *cols)
    pairs = [F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf"))] + [F.struct(F.lit(k).alias("lag"), F.when(F.col("var") > EPS, F.col(f"k{k}") / F.col("var")).otherwise(0.0).alias("acf")) for k in range(1, lags)]
    return one.select(*by, F.inline(F.array(*pairs)))


def autocorrelation_difference(real: DataFrame, synth: DataFrame, lags: int = 64) -> DataFrame:
    acf = pooled_acf(both(real, synth, "channel_idx", "x"), lags, ["channel_idx", "real"])
    wide = acf.groupBy("channel_idx", "lag").agg(F.max(F.when(F.col("real"), F.col("acf"))).alias("r"), F.max(F.when(~F.col("real"), F.col("acf"))).alias("s"))
    return wide.where("r IS NOT NULL AND s IS NOT NULL").groupBy("channel_idx").agg(F.sqrt(F.sum(F.pow(F.col("r") - F.col("s"), F.lit(2)))).alias("acd"))


def method_metrics(real: DataFrame, synth: DataFrame, method: str = "method") -> DataFrame:
    """(method, channel_idx, metric, value): marginal W1 and autocorrelation difference (lags under 16) of every method's windows, all methods in one plan.

    A method has no row for a channel that it or the real side lacks.
    """
    names = synth.select(F.col(method).alias("method"), "channel_idx").distinct()  # a row a method and channel
    against = real.select("channel_idx", "x").join(F.broadcast(names), "channel_idx")
    key = ["method", "channel_idx"]
    rows = both(against, synth.withColumnRenamed(method, "method"), *key, "x")
    w1 = wasserstein(rows.select("real", *key, F.explode("x").alias("v")), key)
    acf = pooled_acf(rows, 16, [*key, "real"]).groupBy(*key, "lag").agg(F.max(F.when(F.col("real"), F.col("acf"))).alias("r"), F.max(F.when(~F.col("real"), F.col("acf"))).alias("s"))
    acd = acf.where("r IS NOT NULL AND s IS NOT NULL").groupBy(*key).agg(F.sqrt(F.sum(F.pow(F.col("r") - F.col("s"), F.lit(2)))).alias("value"))
    return w1.select(*key, F.lit("w1").alias("metric"), F.col("w1").alias("value")).unionByName(acd.select(*key, F.lit("acd").alias("metric"), "value"))


def feature_w1(real: DataFrame, synth: DataFrame) -> DataFrame:
    """(channel_idx, feature, w1) of the six interpretable features."""
    rows = both(real, synth, "channel_idx", A.moments(F.col("x")).alias("m"))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.col(f"m.{f}"), 12).alias("v")) for f in FEATURES])
    return wasserstein(rows.select("real", "channel_idx", F.inline(pairs)), ["channel_idx", "feature"])


def fft_distance(real: DataFrame, synth: DataFrame, width: int) -> DataFrame:
    """Per channel: W1 of dominant amplitudes and of their bins; channels whose real amplitudes vanish are left out."""
    rows = both(real, synth, "channel_idx", spectral.dominant("x").alias("d"))
    live = rows.groupBy("channel_idx").agg(F.max(F.when(F.col("real"), F.col("d.amplitude"))).alias("top")).where(F.col("top") > EPS).select("channel_idx")
    rows = rows.join(live, "channel_idx")
    pairs = F.array(F.struct(F.lit("amplitude").alias("what"), F.col("d.amplitude").alias("v")), F.struct(F.lit("bin").alias("what"), (F.col("d.bin") / max(1, width // 2)).alias("v")))
    w = wasserstein(rows.select("real", "channel_idx", F.inline(pairs)), ["channel_idx", "what"])
    return w.groupBy("channel_idx").agg(F.max(F.when(F.col("what") == "amplitude", F.col("w1"))).alias("amplitude_w1"), F.max(F.when(F.col("what") == "bin", F.col("w1"))).alias("frequency_w1"))


def macro(rows: DataFrame, value: str) -> DataFrame:
    """Mean over channels; NaN of none."""
    return rows.agg(F.coalesce(F.avg(value), F.lit(float("nan"))).alias("value"), F.count(value).alias("n_channels"))


def balanced(rows: DataFrame, seeds: int, *ids: str) -> DataFrame:
    """Rows with ``seed``, 0 to ``seeds`` - 1: for each seed as many of both sides in each channel, chosen by keyed hash; no task sorts a side."""
    n = rows.groupBy("channel_idx").agg(F.least(F.count_if("real"), F.count_if(~F.col("real"))).alias("least"))
    keys = rows.select("channel_idx", "real", *ids).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    keys = keys.withColumn("h", hashing.hashed(0, F.col("seed"), F.col("real"), *map(F.col, ids)))
    placed = ranking.numbered(keys, ["seed", "channel_idx", "real"], ranking.hash_bucket(F.col("h")), ["h", *ids])
    return placed.join(F.broadcast(n), "channel_idx").where(F.col("index") < F.col("least")).select("seed", "real", *ids)


def test_groups(groups: DataFrame, share: float = 0.3) -> DataFrame:
    """Of each ``seed``, ``ceil(share x groups)`` of the distinct groups of column group_id, by keyed hash."""
    h = groups.select("seed", "group_id").distinct().withColumn("h", hashing.hashed(1, F.col("seed"), F.col("group_id")))
    return ranking.numbered(h, ["seed"], ranking.hash_bucket(F.col("h")), ["h", "group_id"]).where(F.col("index") < F.ceil(F.lit(share) * F.col("n"))).select("seed", "group_id")


def null_share(hit: int, said: int, ones: int, zeros: int, n_perm: int, seed: int) -> float:
    """Permutation p-value of a balanced accuracy: dealing the labels anew only changes how many of the ``said`` rows are ones."""
    draws = np.random.default_rng(seed).hypergeometric(ones, zeros, said, n_perm)
    value = lambda k: (k / ones + (zeros - (said - k)) / zeros) / 2
    return float((1 + (value(draws) >= value(hit) - 1e-12).sum()) / (1 + n_perm))


def c2st(real: DataFrame, synth: DataFrame, seeds: int = 5, share: float = 0.3, n_perm: int = 200) -> DataFrame:
    """(seed, accuracy, p_value, n_train, n_test): classifier two-sample tests, all seeds in one plan.

    Sides have channel_idx, group_id, window_id, x. A seed takes as many windows of both
    sides in each channel, holds groups out (none is on both sides of the split), and fits
    a logistic regression; held-out balanced accuracy is compared with that of labels dealt
    anew. Seeds without both classes in training and test give no row.
    """
    rows = both(real, synth, "channel_idx", "group_id", "window_id", "x")
    taken = shared.written(balanced(rows, seeds, "group_id", "window_id"), "c2st")
    held = test_groups(taken, share).withColumn("test", F.lit(True))
    parts = taken.join(held, ["seed", "group_id"], "left").select("real", "window_id", "seed", F.coalesce("test", F.lit(False)).alias("test"))
    # One row a window, however many seeds take it.
    use = parts.groupBy("real", "window_id").agg(F.collect_list(F.when(~F.col("test"), F.col("seed"))).alias("train"), F.collect_list(F.when(F.col("test"), F.col("seed"))).alias("test"))
    ready = shared.written(rows.join(use, ["real", "window_id"]).select(F.col("real").cast("double").alias("label"), F.col("x").alias("f"), "train", "test"), "c2st")
    full = [{r["seed"] for r in ready.select("label", F.explode(part).alias("seed")).groupBy("seed").agg(F.count_distinct("label").alias("k")).where("k = 2").collect()} for part in ("train", "test")]
    good = sorted(full[0] & full[1])
    out = "seed int, accuracy double, p_value double, n_train long, n_test long"
    if not good:
        return rows.sparkSession.createDataFrame([], out)
    number = F.array(*[F.lit(good.index(s) if s in good else None).cast("int") for s in range(seeds)])
    named = lambda c: F.filter(F.transform(c, lambda s: F.get(number, s)), lambda k: k.isNotNull()).alias("models")
    models = grouped.fit(ready.select("label", "f", named("train")), len(good), l2=1.0, balanced=False)
    said = grouped.scored(ready.select("label", "f", named("test")), models, "label")
    one, yes = F.col("label") == 1, F.col("score") >= 0
    counts = said.groupBy("model").agg(F.count_if(one & yes).alias("hit"), F.count_if(yes).alias("said"), F.count_if(one).alias("ones"), F.count_if(~one).alias("zeros"))
    trained = {s: int(models.counts[k].sum()) for k, s in enumerate(good)}

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                s = good[r.model]
                rows.append((s, (r.hit / r.ones + (r.zeros - (r.said - r.hit)) / r.zeros) / 2, null_share(r.hit, r.said, r.ones, r.zeros, n_perm, s), trained[s], r.ones + r.zeros))
            yield pd.DataFrame(rows, columns=["seed", "accuracy", "p_value", "n_train", "n_test"])

    return counts.mapInPandas(judged, out)


def c2st_over_seeds(real: DataFrame, synth: DataFrame, seeds: int = 5, n_perm: int = 200) -> DataFrame:
    """One row: median accuracy, median p-value and share of seeds that reject at 0.05."""
    out = c2st(real, synth, seeds, n_perm=n_perm)  # one row a seed
    return out.agg(F.percentile("accuracy", F.lit(0.5)).alias("accuracy"), F.percentile("p_value", F.lit(0.5)).alias("p_value"), F.avg((F.col("p_value") < 0.05).cast("double")).alias("reject_rate"), F.max("n_test").alias("n_test"))


def audit(real: DataFrame, synth: DataFrame, least: int = 32) -> DataFrame:
    """(channel_idx, n_real, n_synth, tier, w1, acd): what a comparison of two sides may claim, channel by channel.

    A channel with ``least`` windows on both sides is ``evidence``, one with fewer
    ``descriptive``, one that a side lacks ``absent`` (no metrics).
    """
    n = both(real, synth, "channel_idx").groupBy("channel_idx").agg(F.count_if("real").alias("n_real"), F.count_if(~F.col("real")).alias("n_synth"))
    low = F.least("n_real", "n_synth")
    tier = F.when(low >= least, "evidence").when(low > 0, "descriptive").otherwise("absent")
    metrics = marginal_w1(real, synth).join(autocorrelation_difference(real, synth, 16), "channel_idx", "full")
    return n.withColumn("tier", tier).join(metrics, "channel_idx", "left")
