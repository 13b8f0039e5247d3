"""Edits of generated windows against their parents (columns parent, generated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import ranking, spectral


def deviation_patch(parent: Column, generated: Column, tau: float) -> Column:
    """Generated values where they deviate by more than a share tau of the parent's range (squared), else the parent's."""
    if tau <= 0:
        return generated
    return A.let(F.greatest(A.amplitude(parent), F.lit(1e-12)), lambda r: F.zip_with(parent, generated, lambda p, g: F.when(F.pow(p - g, F.lit(2)) > tau * r, g).otherwise(p)))


def patch_share(parent: Column, patched: Column) -> Column:
    """Struct: share of changed values, and whether any is."""
    n = F.size(F.filter(F.zip_with(parent, patched, lambda p, q: p != q), lambda d: d))
    return F.struct((n / F.size(parent)).alias("changed_frac"), (n > 0).alias("changed"))


def residual_copy(rows: DataFrame, n_keep: int = 3) -> DataFrame:
    """``edited``: the parent with the generated window's slow part in place of its own."""
    slow = spectral.slow(n_keep)
    both = rows.withColumns({"sp": slow("parent"), "sg": slow("generated")})
    moved = F.zip_with("sg", "sp", lambda g, p: g - p)
    return both.withColumn("edited", F.zip_with("parent", moved, lambda v, d: v + d)).drop("sp", "sg")


def edit(rows: DataFrame, needles: list[str], n_keep: int = 3, tau: float = 0.05) -> DataFrame:
    """By ``kind_alloc``: needles are patched in, everything else is a residual copy."""
    base = residual_copy(rows, n_keep)
    return base.withColumn("edited", F.when(F.col("kind_alloc").isin(needles), deviation_patch(F.col("parent"), F.col("generated"), tau)).otherwise(F.col("edited")))


def leash(r: Column, kind: str = "l2", delta: float = 0.03) -> Column:
    """Pull towards the parent of a residual array: itself, or saturating."""
    if kind == "l2":
        return r
    if kind == "gm":
        return F.transform(r, lambda v: v / F.pow(1 + F.pow(v / delta, F.lit(2)), F.lit(2)))
    raise ValueError(f"unknown leash {kind}")


def reconstruction(rows: DataFrame) -> DataFrame:
    """One row: RMSE, median RMSE and mean correlation of parents and generated windows."""
    se = A.squared_distance(F.col("parent"), F.col("generated")) / F.size("parent")
    pm, gm = A.mean(F.col("parent")), A.mean(F.col("generated"))
    cov = A.mean(F.zip_with("parent", "generated", lambda p, g: p * g)) - pm * gm
    sds = A.std(F.col("parent")) * A.std(F.col("generated"))
    per = rows.select(se.alias("mse"), F.when(sds > 1e-12, cov / sds).alias("corr"))
    middle = ranking.quantiles(per.select(F.sqrt("mse").alias("rmse")), "rmse", [0.5]).select(F.col("q")[0].alias("median_rmse"))
    return per.agg(F.sqrt(F.avg("mse")).alias("rmse"), F.avg("corr").alias("shape_corr")).join(F.broadcast(middle))  # one row each


def shuffled_null(rows: DataFrame, seed: int = 0) -> DataFrame:
    """One row: RMSE of generated windows against the parent of the next donor in a keyed order of the channel."""
    from orrery.operators.inject import partners

    pairs = partners(rows.select("donor_id", "channel_idx", F.col("parent").alias("x")), seed, "null").select("donor_id", "other")
    se = A.squared_distance(F.col("other"), F.col("generated")) / F.size("other")
    return rows.join(pairs, "donor_id").agg(F.sqrt(F.avg(se)).alias("rmse"))


