"""Choosing settings from tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pick_winners(rows: DataFrame, metric: str, by: str = "family") -> DataFrame:
    """The finite, not exploded row with the largest metric of each family (the smallest id of equals)."""
    live = rows.where(F.col("finite") & ~F.col("explode") & F.col(metric).isNotNull() & ~F.isnan(metric))
    order = Window.partitionBy(by).orderBy(F.col(metric).desc(), "id")
    return live.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def recommend(rows: DataFrame, target: float, floor: float = 0.5, by: str = "encoder") -> DataFrame:
    """Per encoder: viable rows (occupancy of at least ``floor``) first, then least excess of total variation over the real one, most occupancy, most ARP."""
    excess = F.greatest(F.col("tv") / target - 1, F.lit(0.0))
    marked = rows.withColumns({"excess": excess, "viable": F.col("occupancy") >= floor})
    order = Window.partitionBy(by).orderBy(F.col("viable").desc(), "excess", F.col("occupancy").desc(), F.col("arp").desc(), "lam", "id")
    return marked.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def two_sided(value: F.Column, target: F.Column | float) -> F.Column:
    """Relative error either way; NaN for a target near zero."""
    t = target if isinstance(target, F.Column) else F.lit(target)
    return F.when(F.abs(t) < 1e-12, F.lit(float("nan"))).otherwise(F.abs(value - t) / F.abs(t))


def recommend_quiet(rows: DataFrame, tv: float, ratio: float, floor: float = 0.5, by: str = "encoder") -> DataFrame:
    """As ``recommend``, by the sum of two-sided errors of total variation and spectral ratio; an undefined error counts as 1e9."""
    err = lambda c, t: F.coalesce(F.nanvl(two_sided(F.col(c), t), F.lit(1e9)), F.lit(1e9))
    marked = rows.withColumns({"error": err("tv", tv) + err("ratio", ratio), "viable": F.col("occupancy") >= floor})
    order = Window.partitionBy(by).orderBy(F.col("viable").desc(), "error", F.col("occupancy").desc(), "lam", "id")
    return marked.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def pivot_metrics(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Tidy (method, metric, value) to one row per method, means of what is finite."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return rows.groupBy("method").agg(*[F.avg(F.when(F.col("metric") == m, v)).alias(m) for m in metrics])
