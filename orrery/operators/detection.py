"""Detector evaluation from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import hashing, ranking


def threshold_at_far(negatives: DataFrame, far: float = 0.01, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """The score that a share ``far`` of finite negatives exceeds; beyond all for 0, below all for 1. One row (0 of none), or one for each group that has any."""
    by = by or []
    live = negatives.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    if far <= 0:
        t = live.groupBy(*by).agg((F.max(score) + 1e-12).alias("t"))
    elif far >= 1:
        t = live.groupBy(*by).agg((F.min(score) - 1e-12).alias("t"))
    else:
        t = ranking.quantiles(live, score, [1 - far], by).select(*by, F.col("q")[0].alias("t"))
    return t.select(*by, F.coalesce("t", F.lit(0.0)).alias("threshold"))


def event_hits(scores: DataFrame, threshold: Column | float, *by: str) -> DataFrame:
    """Per event: does any window reach the threshold?"""
    return scores.groupBy(*by, "event_id").agg(F.max((F.col("score") >= threshold).cast("int")).alias("hit"))


def ranks(rows: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, score, pos, neg, pos_below, neg_below, pos_total, neg_total): counts of each distinct score, and of those below it."""
    by = by or []
    n = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return ranking.below(n, by, "score", ["pos", "neg"])


def auroc(rows: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; NaN without both."""
    by = by or []
    one = ranks(rows, score, by).groupBy(*by).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return one.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(float("nan")).alias("auroc"))


def average_precision(rows: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Mean precision over recall steps at distinct scores; NaN without positives."""
    by = by or []
    tp, fp = F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")
    r = ranks(rows, score, by).groupBy(*by).agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.nullif(F.max("pos_total"), F.lit(0))).alias("ap"))
    return r.select(*by, F.coalesce("ap", F.lit(float("nan"))).alias("average_precision"))


def bootstrap_recall(hits: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Median and 2.5 and 97.5 percent points of event recall over resampled events.

    Events get dense numbers in the order of a keyed hash; each draw of each resample
    is one row, joined to its event; only sums of a resample move on.
    """
    placed = hits.select("event_id", "hit", hashing.hashed(seed, F.col("event_id")).alias("h"))
    index = ranking.numbered(placed, [], ranking.hash_bucket(F.col("h")), ["h", "event_id"]).select(F.col("index").alias("i"), "hit")
    total = hits.agg(F.count("*").alias("n"))
    draws = index.select(F.col("i").alias("slot")).withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).join(F.broadcast(total))
    draws = draws.select("boot", hashing.pick(seed, F.col("n"), F.col("boot"), F.col("slot")).alias("i"))
    recall = draws.join(index, "i").groupBy("boot").agg(F.avg("hit").alias("recall"))
    p = F.percentile("recall", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return recall.agg(p.alias("p")).select(F.col("p")[1].alias("median"), F.col("p")[0].alias("low"), F.col("p")[2].alias("high"))


def aggregate_arms(rows: DataFrame) -> DataFrame:
    """Per arm: median, mean, least and most recall over seeds, an event counting as hit if it is in any fold; also without leaked rows.

    ``rows`` has arm, seed, fold, event_id, hit, leaked.
    """

    def of(df: DataFrame, name: str) -> DataFrame:
        recall = df.groupBy("arm", "seed", "event_id").agg(F.max("hit").alias("hit")).groupBy("arm", "seed").agg(F.avg("hit").alias("r"))
        return recall.groupBy("arm").agg(F.percentile("r", F.lit(0.5)).alias(f"{name}_median"), F.avg("r").alias(f"{name}_mean"), F.min("r").alias(f"{name}_min"), F.max("r").alias(f"{name}_max"))

    return of(rows, "recall").join(of(rows.where(~F.col("leaked")), "clean"), "arm", "left")


def assert_disjoint(train: DataFrame, test: DataFrame, key: str) -> None:
    """Raise if a row is in both parts."""
    if not train.select(key).join(test.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"{key}: training and test rows overlap")


def evaluate(scores: DataFrame, far: float = 0.01) -> DataFrame:
    """One row: threshold, event recall, n_events, far, rare_far, average_precision, auroc.

    ``scores`` has label (1 anomaly, 0 other), score, event_id (of anomalies) and, if it
    has it, side: the threshold is that of the negatives whose side is not "rare", and
    rare_far is the share of rare ones that reach it.
    """
    rows = scores if "side" in scores.columns else scores.withColumn("side", F.lit("nominal"))
    nominal = rows.where((F.col("label") == 0) & ~F.col("side").eqNullSafe("rare"))
    t = F.broadcast(threshold_at_far(nominal, far))
    at = rows.join(t)
    hits = event_hits(at.where("label = 1"), F.col("threshold")).agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall"), F.count("*").alias("n_events"))
    share = lambda c: F.avg(F.when(c, (F.col("score") >= F.col("threshold")).cast("double")))
    rates = at.agg(F.max("threshold").alias("threshold"), share((F.col("label") == 0) & ~F.col("side").eqNullSafe("rare")).alias("far"), share((F.col("label") == 0) & F.col("side").eqNullSafe("rare")).alias("rare_far"))
    quiet = rows.where((F.col("label") == 1) | ~F.col("side").eqNullSafe("rare"))
    one = rates.join(F.broadcast(hits)).join(F.broadcast(average_precision(quiet))).join(F.broadcast(auroc(quiet)))  # one row each
    return one.select("threshold", "recall", "n_events", "far", "rare_far", "average_precision", "auroc")


def recall_by_kind(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    """(kind, n_events, n_windows, recall, window_recall) of anomalies (kind, event_id, score) at a threshold (one row)."""
    at = scores.join(F.broadcast(threshold)).withColumn("hit", (F.col("score") >= F.col("threshold")).cast("int"))
    events = at.groupBy("kind", "event_id").agg(F.max("hit").alias("e"), F.sum("hit").alias("h"), F.count("*").alias("n"))
    return events.groupBy("kind").agg(F.count("*").alias("n_events"), F.sum("n").alias("n_windows"), F.avg("e").alias("recall"), (F.sum("h") / F.sum("n")).alias("window_recall"))


def evaluate_models(scores: DataFrame, far: float = 0.01) -> DataFrame:
    """``evaluate`` of many models in one plan: a row for each ``model`` that has nominal windows.

    ``scores`` has model, label, score, event_id and side (``nominal``, ``rare`` or
    ``anomaly``). Adds the counts of windows, and the share of anomalous windows found.
    """
    by = ["model"]
    at = scores.join(threshold_at_far(scores.where("side = 'nominal'"), far, by=by), by)
    hit = (F.col("score") >= F.col("threshold")).cast("double")
    share = lambda side: F.avg(F.when(F.col("side") == side, hit))
    of = lambda side: F.count_if(F.col("side") == side)
    rates = at.groupBy(*by).agg(F.max("threshold").alias("threshold"), share("nominal").alias("far"), share("rare").alias("rare_far"), share("anomaly").alias("window_recall"), of("nominal").alias("n_nominal"), of("rare").alias("n_rare"), of("anomaly").alias("n_windows"))
    events = event_hits(at.where("side = 'anomaly'"), F.col("threshold"), *by).groupBy(*by).agg(F.avg("hit").alias("recall"), F.count("*").alias("n_events"))
    quiet = scores.where("side <> 'rare'")
    out = rates.join(events, by, "left").join(average_precision(quiet, by=by), by, "left").join(auroc(quiet, by=by), by, "left")
    return out.na.fill(0.0, ["recall"]).na.fill(0, ["n_events"])


def model_hits(scores: DataFrame, far: float = 0.01) -> DataFrame:
    """(model, kind, event_id, hit): which events each model finds at its own threshold."""
    at = scores.join(threshold_at_far(scores.where("side = 'nominal'"), far, by=["model"]), "model")
    return event_hits(at.where("side = 'anomaly'"), F.col("threshold"), "model", "kind")
