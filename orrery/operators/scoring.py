"""Scores of generated galleries against real windows: nearest distances, coverage, diversity, verdicts.

Queries are a stated set. They meet the gallery block by block (:mod:`orrery.operators.blocks`),
so neither side is ever whole on the driver or in a task; only minima and sums move on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import ranking
from orrery.operators import blocks, nearest


def min_distances(queries: DataFrame, gallery: DataFrame, by: str | None = None, pivots: int = nearest.PIVOTS) -> DataFrame:
    """(query_id, [by,] distance) from each query (query_id, x) to the nearest gallery row (x[, by]); infinite for an empty gallery.

    Exact: the gallery lies in rings around pivots, and rings that the triangle inequality
    rules out are not compared (:mod:`orrery.operators.nearest`).
    """
    near = nearest.distances(queries, gallery, by, pivots)
    if by:
        return near
    return queries.select("query_id").join(near, "query_id", "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def coverage(d: Column, tau: float | Column) -> Column:
    """Share of distances within tau; 0 of none."""
    return F.coalesce(F.avg((d <= tau).cast("double")), F.lit(0.0))


def arp(d: Column) -> Column:
    """1 / (1 + mean finite distance); 0 of none."""
    return F.coalesce(1 / (1 + F.avg(F.when(F.abs(d) != float("inf"), d))), F.lit(0.0))


def score_generator(anomaly: DataFrame, rare: DataFrame, tau: float, by: str = "method") -> DataFrame:
    """Coverage and ARP of both query sets and their gap, per method; inputs are distances (method, distance)."""
    one = lambda df, n: df.groupBy(by).agg(coverage(F.col("distance"), tau).alias(f"coverage_{n}"), arp(F.col("distance")).alias(f"arp_{n}"))
    return one(anomaly, "anomaly").join(one(rare, "rare"), by, "full").withColumn("gap", F.col("coverage_anomaly") - F.col("coverage_rare"))


def choose_tau(distances: DataFrame, target: float = 0.1) -> DataFrame:
    """One row: the distance within which ``target`` of the queries lie (linear between order statistics); no rows is an error."""
    t = ranking.quantiles(distances, "distance", [target])
    return t.select(F.when(F.col("n") > 0, F.col("q")[0]).otherwise(F.raise_error(F.lit("no distances to choose tau from"))).alias("tau"))


def mean_pairwise(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """One row: the mean distance of all pairs of distinct ids; 0 of fewer than two rows. Blocks meet; only sums move."""

    def work(tiles: Iterator[np.ndarray]) -> pd.DataFrame:
        total, n = 0.0, 0
        for d2 in tiles:
            total, n = total + float(np.sqrt(d2).sum()), n + len(d2)
        return pd.DataFrame({"s": [total], "n": [n]})

    out = blocks.among(*blocks.numbered(rows.select(F.col(key).alias("id"), "x"), "pairs"), work, "s double, n long")
    return out.agg(F.coalesce(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("diversity"))


def entropy(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Shannon entropy of counts per group."""
    total = counts.groupBy(by).agg(F.sum(n).alias("total"))
    p = F.col(n) / F.col("total")
    return counts.where(F.col(n) > 0).join(total, by).groupBy(by).agg((-F.sum(p * F.log(p))).alias("edi"))


def edi(union: DataFrame, regions: int = 16, seed: int = 0) -> DataFrame:
    """Entropy of each method over k-means regions of the union (method, x); comparable within one union only."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = union.select("method", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    n = rows.limit(regions).count()
    if not n:
        return union.sparkSession.createDataFrame([], "method string, edi double")
    model = KMeans(k=max(2, min(regions, n)), seed=seed, featuresCol="features", predictionCol="region").fit(rows)
    return entropy(model.transform(rows).groupBy("method", "region").agg(F.count("*").alias("n")), "method")


def win_rule(scores: DataFrame, ours: str, beat: list[str], occupancy_min: float = 0.8, ratio_min: float = 0.8, reference: str = "unguided") -> DataFrame:
    """One row: does our method beat every listed gap, with enough occupancy and diversity?

    ``scores`` has method, gap, occupancy, diversity. A reference without diversity gives ratio 0.
    """
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    one = scores.agg(of(ours, "gap").alias("gap"), of(ours, "occupancy").alias("occupancy"), of(ours, "diversity").alias("diversity"), of(reference, "diversity").alias("base"), *[of(m, "gap").alias(f"gap_{m}") for m in beat])
    ratio = F.when(F.col("base") > 0, F.col("diversity") / F.col("base")).otherwise(0.0)
    beats = F.lit(True)
    for m in beat:
        beats = beats & (F.col("gap") > F.col(f"gap_{m}"))
    ok = F.col("occupancy") >= occupancy_min
    return one.select("gap", ratio.alias("diversity_ratio"), ok.alias("occupancy_ok"), ((F.col("base") > 0) & (ratio >= ratio_min)).alias("diversity_ok"), beats.alias("beats_all"), (ok & (F.col("base") > 0) & (ratio >= ratio_min) & beats).alias("won"))
