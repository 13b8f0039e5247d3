"""Event-disjoint folds and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import hashing, ranking


def event_folds(labeled: DataFrame, n_folds: int = 3, seed: int = 0) -> DataFrame:
    """(event_id, is_anomaly, fold): all windows of an event share a fold.

    Stratified by the event's label if both classes have as many events as folds;
    otherwise plain; a single event is in fold 0. Which fold is a matter of a keyed hash.
    """
    events = labeled.groupBy("event_id").agg(F.max("is_anomaly").alias("is_anomaly"))
    sizes = events.agg(F.count_if("is_anomaly").alias("a"), F.count_if(~F.col("is_anomaly")).alias("b"))
    h = hashing.hashed(seed, F.col("event_id"))
    both = events.join(F.broadcast(sizes)).withColumn("stratum", F.when(F.least("a", "b") >= n_folds, F.col("is_anomaly").cast("int")).otherwise(0))
    ranked = ranking.numbered(both.withColumn("h", h), ["stratum"], ranking.hash_bucket(F.col("h")), ["h", "event_id"])
    return ranked.select("event_id", "is_anomaly", F.when(F.col("a") + F.col("b") < 2, 0).otherwise(F.col("index") % n_folds).cast("int").alias("fold"))


def channel_fold_counts(folded: DataFrame, least: int, n_folds: int = 3) -> DataFrame:
    """Anomaly and rare windows of every channel and fold, zeros too, and whether anomalies are fewer than ``least``."""
    counts = folded.groupBy("channel", "fold").agg(F.count_if("is_anomaly").alias("n_anomaly_windows"), F.count_if("is_rare").alias("n_rare_windows"))
    dense = folded.select("channel").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    rows = dense.join(counts, ["channel", "fold"], "left").na.fill(0, ["n_anomaly_windows", "n_rare_windows"])
    return rows.withColumn("below_min", F.col("n_anomaly_windows") < least)


def keep_fold(folded: DataFrame, counts: DataFrame, fold: int | None = None) -> DataFrame:
    """Windows of channels and folds that have enough anomalies."""
    rows = folded if fold is None else folded.where(F.col("fold") == fold)
    return rows.join(counts.where("below_min").select("channel", "fold"), ["channel", "fold"], "left_anti")


def fold_means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means over folds of per-fold metrics; NaN and null do not count."""
    return rows.groupBy(*by).agg(*[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics], F.count("*").alias("n_folds"))
