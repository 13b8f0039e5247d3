"""Statistics of a window, an array of doubles without nulls, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def std(x: Column) -> Column:
    """Population standard deviation."""
    return let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def steps(x: Column) -> Column:
    """First differences."""
    return F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda b, a: b - a)


def amplitude(x: Column) -> Column:
    return F.array_max(x) - F.array_min(x)


def level_shift(x: Column) -> Column:
    """Distance of the means of the two halves (the first has W div 2 values)."""
    half = F.floor(F.size(x) / 2).cast("int")
    return F.abs(mean(F.slice(x, 1, half)) - mean(F.slice(x, half + 1, F.size(x) - half)))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true values."""
    zero = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"))

    def step(a: Column, v: Column) -> Column:
        now = F.when(v, a["now"] + 1).otherwise(0)
        return F.struct(F.greatest(a["best"], now).alias("best"), now.alias("now"))

    return F.aggregate(flags, zero, step, lambda a: a["best"])


def zscores(x: Column) -> Column:
    """(x - mean) / std; a window with a std under 1e-8 is only centred."""
    return let(F.struct(mean(x).alias("m"), std(x).alias("d")), lambda p: _scaled(x, p))


def _scaled(x: Column, p: Column) -> Column:
    return let(F.struct(p["m"].alias("m"), F.when(p["d"] < 1e-8, F.lit(1.0)).otherwise(p["d"]).alias("s")), lambda p: F.transform(x, lambda v: (v - p["m"]) / p["s"]))


def total_variation(x: Column) -> Column:
    return total(F.transform(steps(x), F.abs)) / (F.size(x) - 1)


def median(x: Column) -> Column:
    def of(s: Column) -> Column:
        n = F.size(s)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2

    return let(F.array_sort(x), of)


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""

    def of(s: Column) -> Column:
        at = F.lit(q) * (F.size(s) - 1)
        lo = F.floor(at).cast("int")
        a, b = F.element_at(s, lo + 1), F.element_at(s, F.least(lo + 2, F.size(s)))
        return a + (b - a) * (at - lo)

    return let(F.array_sort(x), of)


def rolling_residual(x: Column, width: int = 9) -> Column:
    """x minus its rolling median over an odd width, with the edges repeated."""
    half = width // 2
    padded = F.concat(F.array_repeat(F.element_at(x, 1), half), x, F.array_repeat(F.element_at(x, -1), half))
    return let(padded, lambda p: F.transform(x, lambda v, t: v - F.element_at(F.array_sort(F.slice(p, t + 1, width)), half + 1)))


def signed_peak(x: Column, width: int = 9) -> Column:
    """Struct (severity, position): the residual of largest size, the first of equals, at t / (W - 1)."""

    def of(r: Column) -> Column:
        best = F.aggregate(F.transform(r, lambda v, t: F.struct(v.alias("v"), t.alias("t"))), F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("t")), lambda a, b: F.when(F.abs(b["v"]) > F.abs(a["v"]), b).otherwise(a))
        return let(best, lambda s: F.struct(s["v"].alias("severity"), (s["t"] / (F.size(r) - 1)).alias("position")))

    return let(rolling_residual(x, width), of)


def cusum(x: Column, least: int = 1) -> Column:
    """Struct (contrast, split): the signed scaled difference of the means before and after the best split, the first of equals."""

    def of(n: Column, m: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(0.0).alias("best"), F.lit(0).alias("at"))

        def step(a: Column, v: Column) -> Column:
            s, k = a["sum"] + (v - m), a["k"] + 1
            c = s / F.sqrt(k * (n - k) / n)
            ok = (k >= least) & (n - k >= least) & ((a["at"] == 0) | (F.abs(c) > F.abs(a["best"])))
            return F.struct(s.alias("sum"), k.alias("k"), F.when(ok, c).otherwise(a["best"]).alias("best"), F.when(ok, k).otherwise(a["at"]).alias("at"))

        return F.aggregate(x, zero, step, lambda a: F.struct(a["best"].alias("contrast"), (a["at"] / n).alias("split")))

    return let(F.struct(F.size(x).alias("n"), mean(x).alias("m")), lambda p: of(p["n"], p["m"]))


def persistence(x: Column) -> Column:
    """Mean of the last quarter minus mean of the first."""
    q = F.greatest(F.lit(1), F.floor(F.size(x) / 4).cast("int"))
    return mean(F.slice(x, F.size(x) - q + 1, q)) - mean(F.slice(x, 1, q))


def excursions(x: Column, width: int = 9, scale: float = 4.0) -> Column:
    """Runs of residuals beyond ``scale`` median deviations (at least 1e-12) from their median."""

    def of(r: Column) -> Column:
        mad = let(median(r), lambda m: F.struct(m.alias("m"), F.greatest(median(F.transform(r, lambda v: F.abs(v - m))), F.lit(1e-12)).alias("d")))
        flags = let(mad, lambda p: F.transform(r, lambda v: (F.abs(v - p["m"]) > scale * p["d"]).cast("int")))
        return let(flags, lambda f: F.aggregate(F.transform(f, lambda v, t: F.when((v == 1) & ((t == 0) | (F.get(f, t - 1) == 0)), 1).otherwise(0)), F.lit(0), lambda a, v: a + v))

    return let(rolling_residual(x, width), of)


def moments(x: Column) -> Column:
    """Struct of mean, std, trend over a unit of time, skewness, excess kurtosis and lag-1 autocorrelation.

    A constant window has skewness 0, excess kurtosis -3 and autocorrelation 0.
    """

    def of(m: Column) -> Column:
        d = F.transform(x, lambda v: v - m)
        return let(
            d,
            lambda c: let(
                F.struct(mean(F.transform(c, lambda v: v * v)).alias("v2"), mean(F.transform(c, lambda v: v * v * v)).alias("v3"), mean(F.transform(c, lambda v: v * v * v * v)).alias("v4"), total(F.transform(c, lambda v, t: v * t)).alias("ct"), total(F.zip_with(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, F.size(c) - 1), lambda a, b: a * b)).alias("lag")),
                lambda s: F.struct(
                    m.alias("mean"),
                    F.sqrt(s["v2"]).alias("std"),
                    (s["ct"] * (F.size(x) - 1) / (F.size(x) * (F.pow(F.size(x), F.lit(2)) - 1) / 12)).alias("trend"),
                    F.when(s["v2"] > 1e-24, s["v3"] / F.pow(s["v2"], F.lit(1.5))).otherwise(0.0).alias("skew"),
                    F.when(s["v2"] > 1e-24, s["v4"] / (s["v2"] * s["v2"]) - 3).otherwise(-3.0).alias("kurtosis"),
                    F.when(s["v2"] > 1e-24, s["lag"] / (s["v2"] * F.size(x))).otherwise(0.0).alias("acf1"),
                ),
            ),
        )

    return let(mean(x), of)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def acf(x: Column, lags: int) -> Column:
    """Biased autocorrelations of lags 0 to lags - 1: 1 at lag 0; 0 beyond it for a constant window."""

    def of(c: Column) -> Column:
        power = total(F.transform(c, lambda v: v * v))
        at = lambda k: total(F.zip_with(F.slice(c, 1, F.size(c) - k), F.slice(c, k + 1, F.size(c) - k), lambda a, b: a * b))
        return let(power, lambda p: F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda k: F.when(k == 0, 1.0).when((p > 1e-12) & (k < F.size(c)), at(k) / p).otherwise(0.0)))

    return let(let(mean(x), lambda m: F.transform(x, lambda v: v - m)), of)


def shape_scores(a: Column, b: Column) -> Column:
    """Struct (r2, corr) of b against a after both are centred; 0 where a (for corr: either) is constant."""

    def of(p: Column) -> Column:
        va, vb = total(F.transform(p["a"], lambda v: v * v)), total(F.transform(p["b"], lambda v: v * v))
        ab, off = total(F.zip_with(p["a"], p["b"], lambda x, y: x * y)), squared_distance(p["a"], p["b"])
        return F.struct(F.when(va > 1e-12, 1 - off / va).otherwise(0.0).alias("r2"), F.when((va > 1e-12) & (vb > 1e-12), ab / F.sqrt(va * vb)).otherwise(0.0).alias("corr"))

    centred = lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    return let(F.struct(centred(a).alias("a"), centred(b).alias("b")), of)


def hf_lf(bands: Column) -> Column:
    """Energy of the upper two of four log-bands over that of the lower two."""
    e = lambda i: F.exp(bands[i])
    return (e(2) + e(3)) / (e(0) + e(1))
