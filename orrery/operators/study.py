"""Do generated anomalies help a detector? Every arm, fold and seed is a model, all trained in one plan.

An arm says what its positives are: real anomalies of the other folds, windows of one
gallery, or both. Isolation is by fold: an event is in one fold; a nominal window tests in
the fold of its own part and trains in the others; a generated window trains only where its
donor does. The detector stands in for a small convolutional network: a logistic model on
the scaled window, its largest deviations wherever they are, its level shift and its
variation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import hashing, ranking, shared
from orrery.operators import detection, grouped

TOP = 8


@dataclass(frozen=True)
class Arm:
    name: str
    gallery: str | None
    real: bool


def features(x: Column, width: int) -> Column:
    """The window, its ``TOP`` largest deviations from its mean, the difference of its halves' means, its total variation."""
    far = A.let(A.mean(x), lambda m: F.slice(F.sort_array(F.transform(x, lambda v: F.abs(v - m)), asc=False), 1, TOP))
    shift = F.abs(A.mean(F.slice(x, 1, width // 2)) - A.mean(F.slice(x, width // 2 + 1, width - width // 2)))
    return F.concat(x, far, F.array(shift, A.total_variation(x)))


@dataclass(frozen=True)
class Plan:
    arms: tuple[Arm, ...]
    folds: int = 3
    seeds: int = 5
    n_synth: int = 256
    n_nominal: int = 512
    key: int = 0

    @property
    def n(self) -> int:
        return len(self.arms) * self.folds * self.seeds

    def models(self, takes) -> Column:
        """The models for which ``takes(arm's number, fold, seed)`` holds."""
        per = self.folds * self.seeds
        return F.filter(F.sequence(F.lit(0), F.lit(self.n - 1)), lambda m: takes(F.floor(m / per), F.floor(m / self.seeds) % self.folds, m % self.seeds)).alias("models")

    def arms_with(self, test) -> Column:
        return F.array(*[F.lit(i) for i, a in enumerate(self.arms) if test(a)]).cast("array<long>")

    def names(self, model: Column) -> list[Column]:
        per = self.folds * self.seeds
        return [F.get(F.array(*[F.lit(a.name) for a in self.arms]), F.floor(model / per).cast("int")).alias("arm"), (F.floor(model / self.seeds) % self.folds).cast("int").alias("fold"), (model % self.seeds).cast("int").alias("seed")]


def drawn(rows: DataFrame, plan: Plan, by: list[str], most: int, own: Column) -> DataFrame:
    """``rows`` with ``slots``: the (fold x seeds + seed) in which a row is among ``most`` drawn without replacement, of the folds that ``own`` holds for."""
    slot = F.explode(F.sequence(F.lit(0), F.lit(plan.folds * plan.seeds - 1)))
    keys = rows.select("donor_id", *by, slot.alias("slot")).withColumn("fold", F.floor(F.col("slot") / plan.seeds)).where(own)
    keys = keys.withColumn("h", hashing.hashed(plan.key, F.col("slot"), F.col("donor_id")))
    placed = ranking.numbered(keys, [*by, "slot"], ranking.hash_bucket(F.col("h")), ["h", "donor_id"]).where(F.col("index") < most)
    return rows.join(placed.groupBy("donor_id", *by).agg(F.collect_list("slot").alias("slots")), ["donor_id", *by])


def sets(plan: Plan, labeled: DataFrame, nominal: DataFrame, galleries: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Training rows (models, label, f) and test rows (models, label, side, event_id, kind, f).

    ``labeled`` has event_id, fold, side (anomaly or rare), kind and x; ``nominal`` donor_id
    and x; ``galleries`` method, donor_id and x. An event in two folds is an error.
    """
    if not labeled.groupBy("event_id").agg(F.count_distinct("fold").alias("k")).where("k > 1").isEmpty():
        raise ValueError("an event is in two folds")
    f = features(F.col("x"), width).alias("f")
    part = F.pmod("donor_id", F.lit(plan.folds))
    own, real = F.col("fold"), plan.arms_with(lambda a: a.real)
    good = labeled.where("side = 'anomaly'").select(plan.models(lambda a, k, s: F.array_contains(real, a) & (k != own)), F.lit(1).alias("label"), f)
    rare = labeled.where("side = 'rare'").select(plan.models(lambda a, k, s: k != own), F.lit(0).alias("label"), f)
    plain = nominal.select(plan.models(lambda a, k, s: k != part), F.lit(0).alias("label"), f)
    made = drawn(galleries, plan, ["method"], plan.n_synth, F.col("fold") != part)
    which = F.array(*[F.coalesce(F.lit(a.gallery), F.lit("")) for a in plan.arms])
    made = made.select(plan.models(lambda a, k, s: (F.get(which, a.cast("int")) == F.col("method")) & F.array_contains("slots", (k * plan.seeds + s).cast("int"))), F.lit(1).alias("label"), f)
    train = good.unionByName(rare).unionByName(plain).unionByName(made).where("size(models) > 0")
    event = [F.col("event_id").cast("string").alias("event_id"), F.col("kind").cast("string").alias("kind")]
    told = labeled.select(plan.models(lambda a, k, s: k == own), (F.col("side") == "anomaly").cast("int").alias("label"), "side", *event, f)
    quiet = drawn(nominal, plan, [], plan.n_nominal, F.col("fold") == part)
    quiet = quiet.select(plan.models(lambda a, k, s: F.array_contains("slots", (k * plan.seeds + s).cast("int"))), F.lit(0).alias("label"), F.lit("nominal").alias("side"), *[F.lit(None).cast("string").alias(c) for c in ("event_id", "kind")], f)
    return train, told.unionByName(quiet)


def scores(plan: Plan, labeled: DataFrame, nominal: DataFrame, galleries: DataFrame, width: int) -> tuple[DataFrame, grouped.Models]:
    """(model, score, label, side, event_id, kind) of every model's test rows, written once; and the models."""
    train, test = sets(plan, labeled, nominal, galleries, width)
    models = grouped.fit(train, plan.n)
    return shared.written(grouped.scored(test, models, "label", "side", "event_id", "kind"), "scores"), models


def report(plan: Plan, scored: DataFrame, models: grouped.Models, far: float = 0.01, n_boot: int = 1000) -> DataFrame:
    """A row an arm, fold and seed: counts, threshold, recall of events and its bootstrap interval, false alarms, precision, AUROC.

    Resampling events with replacement only draws how many of them are found: a binomial
    number, so the interval needs the counts alone.
    """
    rows = detection.evaluate_models(scored, far)
    counts = [(i, int(n), int(p)) for i, (n, p) in enumerate(models.counts)]
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema)
    key = plan.key

    def interval(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [np.quantile(np.random.default_rng([key, m]).binomial(n, r, n_boot) / n, [0.5, 0.025, 0.975]) if n else np.zeros(3) for m, n, r in zip(b.model, b.n_events, b.recall, strict=True)]
            low = np.array(ends).reshape(-1, 3)
            yield b.assign(recall_boot=low[:, 0], recall_low=low[:, 1], recall_high=low[:, 2])

    sized = rows.sparkSession.createDataFrame(counts, "model int, n_neg long, n_pos long")  # a row a model
    out = rows.mapInPandas(interval, f"{kinds}, recall_boot double, recall_low double, recall_high double").join(F.broadcast(sized), "model")
    return out.select(*plan.names(F.col("model")), *[c for c in out.columns if c != "model"])


def summary(plan: Plan, scored: DataFrame, far: float = 0.01, leaks: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Per arm: recall over the seeds, an event counting once over the folds, with and without the folds that ``leaks`` names."""
    hits = detection.model_hits(scored, far)
    named = hits.select(*plan.names(F.col("model")), "event_id", "hit")
    leaked = F.lit(False)
    for arm, fold in leaks:
        leaked = leaked | ((F.col("arm") == arm) & (F.col("fold") == fold))
    return detection.aggregate_arms(named.withColumn("leaked", leaked))
