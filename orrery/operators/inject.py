"""Rule-based synthetic anomalies on nominal windows (donor_id, channel_idx, x).

Every choice is a keyed hash of the donor, so a gallery does not depend on
partitions, and window i is always the edit of donor i. Other donors come from a
ring within the channel; only the partner's window moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import hashing as H
from orrery.functions import ranking

POSTHOC = ("step", "pulse", "ramp", "scale")
TAXONOMY = ("point", "contextual", "shapelet", "seasonal", "trend")


def _u(seed: int, name: str) -> Column:
    return H.uniform(seed, F.lit(name), F.col("donor_id"))


def _i(seed: int, name: str, lo: Column | int, hi: Column | int) -> Column:
    """A whole number in lo to hi - 1."""
    lo, hi = (F.lit(v) if isinstance(v, int) else v for v in (lo, hi))
    return (lo + H.hashed(seed, F.lit(name), F.col("donor_id")) % F.greatest(hi - lo, F.lit(1))).cast("int")


def sd(x: Column) -> Column:
    return A.let(A.std(x), lambda s: F.when(s < 1e-8, F.lit(1.0)).otherwise(s))


def _known(families: tuple[str, ...], allowed: tuple[str, ...]) -> None:
    if not families or set(families) - set(allowed):
        raise ValueError(f"families must be some of {allowed}")


def donors(nominal: DataFrame, per_channel: int, seed: int) -> DataFrame:
    """(donor_id, channel_idx, x): ``per_channel`` windows of each channel by keyed hash; too few in one is an error."""
    order = Window.partitionBy("channel_idx").orderBy(H.hashed(seed, F.col("channel_idx"), F.col("start")), "start")
    rows = nominal.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_channel)
    short = rows.groupBy("channel_idx").count().where(F.col("count") < per_channel).collect()
    if short:
        raise ValueError(f"channels with fewer than {per_channel} windows: {[r['channel_idx'] for r in short]}")
    return rows.select((F.col("channel_idx") * per_channel + F.col("rank") - 1).cast("long").alias("donor_id"), "channel_idx", "x")


def posthoc(nominal: DataFrame, width: int, seed: int = 0, families: tuple[str, ...] = POSTHOC, severity: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """A step, a pulse, a ramp or a change of scale, in units of the window's standard deviation."""
    _known(families, POSTHOC)
    w, (s0, s1) = width, severity
    rows = nominal.withColumns({
        "family": F.element_at(F.array(*map(F.lit, families)), _i(seed, "family", 1, len(families) + 1)),
        "sign": F.when(_u(seed, "sign") < 0.5, 1.0).otherwise(-1.0),
        "amp": s0 + (s1 - s0) * _u(seed, "amp"),
        "more": s0 + (s1 - s0) * _u(seed, "more"),
        "sd": sd(F.col("x")),
        "step0": _i(seed, "step0", w // 8, max(w // 8 + 1, 7 * w // 8)),
        "pulse0": _i(seed, "pulse0", 0, max(w - 8, 1)),
        "dur": _i(seed, "dur", 4, max(5, w // 8)),
        "ramp0": _i(seed, "ramp0", 0, max(w // 2, 1)),
    }).withColumns({"ramp1": _i(seed, "ramp1", F.col("ramp0") + 4, w + 1), "a": F.col("sign") * F.col("amp") * F.col("sd")})
    c = F.col
    y = (
        F.when(c("family") == "step", F.transform("x", lambda v, t: F.when(t >= c("step0"), v + c("a")).otherwise(v)))
        .when(c("family") == "pulse", F.transform("x", lambda v, t: F.when((t >= c("pulse0")) & (t < c("pulse0") + c("dur")), v + c("a")).otherwise(v)))
        .when(c("family") == "ramp", F.transform("x", lambda v, t: F.when((t >= c("ramp0")) & (t < c("ramp1")), v + c("a") * (t - c("ramp0")) / (c("ramp1") - c("ramp0") - 1)).otherwise(v)))
        .otherwise(F.transform("x", lambda v: v * (1 + c("sign") * c("more") * 0.25)))
    )
    return rows.select("donor_id", "channel_idx", "family", y.alias("x"))


def partners(nominal: DataFrame, seed: int, name: str = "partner") -> DataFrame:
    """``nominal`` with ``other``: the window of another donor of the channel (its own where it is alone).

    Donors of a channel are numbered by keyed hash; the partner is a hashed number of steps on.
    """
    spots = nominal.select("donor_id", "channel_idx", "x", H.hashed(seed, F.lit(name), F.col("donor_id")).alias("h"))
    ring = ranking.numbered(spots, ["channel_idx"], ranking.hash_bucket(F.col("h")), ["h", "donor_id"]).withColumnRenamed("index", "at")
    hop = F.when(F.col("n") > 1, 1 + H.hashed(seed, F.lit(name + " hop"), F.col("donor_id")) % (F.col("n") - 1)).otherwise(0)
    mine = ring.withColumn("to", (F.col("at") + hop) % F.col("n"))
    there = ring.select("channel_idx", F.col("at").alias("to"), F.col("x").alias("other"))
    return mine.join(there, ["channel_idx", "to"]).select("donor_id", "channel_idx", "x", "other")


def cutaddpaste(nominal: DataFrame, width: int, seed: int = 0, frac: tuple[float, float] = (0.08, 0.35), trend: float = 0.5, jitter: float = 0.05, n_paste: int = 1) -> DataFrame:
    """A patch of another donor of the channel, with a trend and jitter, at a place of its own; ``n_paste`` times in turn."""
    w = width
    lo = min(max(frac[0], 1 / w), 1.0)
    hi = min(max(frac[1], lo), 1.0)
    out = nominal.select("donor_id", "channel_idx", "x")
    base = out.withColumn("sd", sd(F.col("x")))
    for k in range(max(1, n_paste)):
        s = seed * 1000 + k
        pair = partners(nominal, s).select("donor_id", "other")
        size = F.least(F.lit(w), _i(s, "len", max(4, round(lo * w)), max(5, round(hi * w) + 1)))
        rows = base.join(pair, "donor_id").withColumn("len", size)
        rows = rows.withColumns({"c0": _i(s, "cut", F.lit(0), w - F.col("len") + 1), "p0": _i(s, "paste", F.lit(0), w - F.col("len") + 1), "slope": (2 * _u(s, "slope") - 1) * trend * F.col("sd")})
        c = F.col
        i = lambda t: t - c("p0")
        noise = lambda t: jitter * c("sd") * H.gauss(s, F.lit("jitter"), c("donor_id"), i(t)) if jitter else F.lit(0.0)
        y = F.transform("x", lambda v, t: F.when((t >= c("p0")) & (t < c("p0") + c("len")), F.get("other", c("c0") + i(t)) + c("slope") * i(t) / (c("len") - 1) + noise(t)).otherwise(v))
        base = rows.select("donor_id", "channel_idx", "sd", y.alias("x"))
    return base.select("donor_id", "channel_idx", "x")


def taxonomy(nominal: DataFrame, width: int, seed: int = 0, families: tuple[str, ...] = TAXONOMY, severity: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Point, contextual, shapelet, seasonal or trend outliers."""
    _known(families, TAXONOMY)
    w, (s0, s1), c = width, severity, F.col
    k, least = max(4, w // 16), min(max(8, w // 16), w)
    span_min = min(max(8, w // 8), w)
    wave_min = min(max(16, w // 8), w)
    rows = partners(nominal, seed).withColumns({
        "family": F.element_at(F.array(*map(F.lit, families)), _i(seed, "family", 1, len(families) + 1)),
        "sign": F.when(_u(seed, "sign") < 0.5, 1.0).otherwise(-1.0),
        "sev": s0 + (s1 - s0) * _u(seed, "sev"),
        "sd": sd(c("x")),
        "n_pts": _i(seed, "points", 1, 4),
        "pt": _i(seed, "point", 0, w),
        "hop": _i(seed, "hop", 1, max(2, w // 3)),
        "boost": 2 + 3 * _u(seed, "boost"),
        "ct": _i(seed, "context", k, max(k + 1, w - k)),
        "cboost": 3 + 3 * _u(seed, "cboost"),
        "len": F.least(F.lit(w), _i(seed, "len", least, max(least + 1, w // 4))),
        "t0": _i(seed, "t0", 0, max(w - span_min + 1, 1)),
        "w0": _i(seed, "w0", 0, max(w - wave_min + 1, 1)),
        "period": 12 + (max(13.0, w / 4) - 12) * _u(seed, "period"),
    })
    rows = rows.withColumns({"c0": _i(seed, "cut", F.lit(0), w - c("len") + 1), "p0": _i(seed, "paste", F.lit(0), w - c("len") + 1), "t1": _i(seed, "t1", c("t0") + span_min, w + 1), "w1": _i(seed, "w1", c("w0") + wave_min, w + 1), "a": c("sign") * c("sev") * c("sd")})
    around = F.concat(F.slice("x", c("ct") - k + 1, k), F.slice("x", c("ct") + 2, k))
    patch = F.slice("other", c("c0") + 1, c("len"))
    rows = rows.withColumns({"mu": A.mean(around), "near": F.greatest(A.std(around), 0.25 * c("sd"), F.lit(1e-8)), "shift": A.mean(F.slice("x", c("p0") + 1, c("len"))) - A.mean(patch), "patch": F.reverse(patch)})
    one = lambda t, j: (c("n_pts") > j) & (t == (c("pt") + j * c("hop")) % w)
    y = (
        F.when(c("family") == "point", F.transform("x", lambda v, t: F.when(one(t, 0) | one(t, 1) | one(t, 2), v + c("a") * c("boost")).otherwise(v)))
        .when(c("family") == "contextual", F.transform("x", lambda v, t: F.when(t == c("ct"), c("mu") + c("sign") * c("sev") * c("near") * c("cboost")).otherwise(v)))
        .when(c("family") == "shapelet", F.transform("x", lambda v, t: F.when((t >= c("p0")) & (t < c("p0") + c("len")), F.get("patch", t - c("p0")) + c("shift")).otherwise(v)))
        .when(c("family") == "seasonal", F.transform("x", lambda v, t: F.when((t >= c("w0")) & (t < c("w1")), v + c("a") * F.sin(2 * math.pi * (t - c("w0")) / c("period"))).otherwise(v)))
        .otherwise(F.transform("x", lambda v, t: F.when((t >= c("t0")) & (t < c("t1")), v + c("a") * (t - c("t0")) / (c("t1") - c("t0") - 1)).otherwise(v)))
    )
    return rows.select("donor_id", "channel_idx", "family", y.alias("x"))
