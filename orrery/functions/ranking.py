"""Exact numbers and quantiles of large tables without a sort in one task.

Rows are dealt into buckets that follow the order; running sums over the few buckets
give each a base, and only within a bucket rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(h: Column) -> Column:
    """The bucket of a 32-bit hash, in its order."""
    return F.shiftright(h, 22)


def number_bucket(rows: DataFrame, col: str, buckets: int = 64) -> Column:
    """A bucket that follows a number; its bounds are approximate quantiles, fewer than ``buckets`` numbers on the driver."""
    cuts = rows.agg(F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 10_000).alias("p")).first()["p"] or []
    return sum(((F.col(col) > c).cast("int") for c in sorted(set(cuts))), F.lit(0))


def numbered(rows: DataFrame, by: list[str], bucket: Column, order: list[str | Column]) -> DataFrame:
    """``rows`` with ``index`` (from 0, in order within each group of ``by``, whose columns are not null) and ``n``, the size of the group."""
    at = rows.withColumn("_bucket", bucket)
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for a bucket
    sizes = at.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    tops = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("n"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return at.join(tops, [*by, "_bucket"]).withColumn("index", F.col("_base") + F.row_number().over(inside) - 1).drop("_bucket", "_base")


def tile(index: Column, n: Column, k: int) -> Column:
    """Which of k even tiles (from 0) an index of n falls into; the first ones are one larger where it does not divide."""
    q, r = F.floor(n / k), n % k
    wide = r * (q + 1)
    return F.when(index < wide, F.floor(index / (q + 1))).otherwise(r + F.floor((index - wide) / F.greatest(q, F.lit(1)))).cast("int")


def below(counts: DataFrame, by: list[str], value: str, sums: list[str], buckets: int = 64) -> DataFrame:
    """``counts`` (one row for each ``value`` of a group) with, for each column c of ``sums``, c_below (over smaller values of the group) and c_total.

    Buckets follow the values; their bounds are approximate quantiles of the different
    values, so one outlier moves no other value, and no bucket holds many more than its
    share. The bounds stay in the plan: nothing comes to the driver.
    """
    cuts = counts.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"))
    at = counts.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    whole, inside = Window.partitionBy(*by), Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows a group
    zero = F.lit(0)
    tops = at.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in sums]).select(*by, "_b", *[F.coalesce(F.sum(c).over(before), zero).alias(f"_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums])
    placed = at.join(tops, [*by, "_b"])
    return placed.select(*counts.columns, *[(F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), zero)).alias(f"{c}_below") for c in sums], *[f"{c}_total" for c in sums])


def quantiles(rows: DataFrame, col: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """``n`` and ``q``, the quantiles of the values that are not null (linear between order statistics; nulls of none).

    One row, or one for each group of ``by`` that has values.
    """
    by = by or []
    counts = rows.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed = below(counts, by, "v", ["c"])
    value = lambda k: F.max(F.when((F.col("c_below") <= k) & (k < F.col("c_below") + F.col("c")), F.col("v")))
    spots = [F.lit(p) * (F.col("c_total") - 1) for p in shares]
    each = [c for i, s in enumerate(spots) for c in (value(F.floor(s)).alias(f"a{i}"), value(F.ceil(s)).alias(f"b{i}"))]
    found = placed.groupBy(*by).agg(F.coalesce(F.max("c_total"), F.lit(0)).alias("n"), *each)

    def between(i: int, p: float) -> Column:
        spot = F.lit(p) * (F.col("n") - 1)
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        return F.when(a == b, a).otherwise(a + (b - a) * (spot - F.floor(spot)))

    return found.select(*by, "n", F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("q"))


def with_medians(groups: DataFrame, rows: DataFrame, by: list[str], **columns: str) -> DataFrame:
    """``groups`` (one row a group) with the medians of columns of ``rows`` under the given names; a null group has null ones."""
    for name, col in columns.items():
        groups = groups.join(quantiles(rows, col, [0.5], by).select(*by, F.col("q")[0].alias(name)), by, "left")
    return groups


def lower_median(rows: DataFrame, col: str, times: str) -> DataFrame:
    """One row: the value at place floor((n - 1) / 2) of values that each count ``times``; null of none."""
    at = below(rows.groupBy(F.col(col).alias("v")).agg(F.sum(times).alias("c")), [], "v", ["c"])
    k = F.floor((F.col("c_total") - 1) / 2)
    return at.agg(F.max(F.when((F.col("c_below") <= k) & (k < F.col("c_below") + F.col("c")), F.col("v"))).alias("v"))
