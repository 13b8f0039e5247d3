"""Out-of-fold generation and scoring: for each fold, galleries steered by the other folds' anomalies meet this fold's windows.

The fold is a key through references, recipes, galleries and queries, so one plan makes
and scores all folds. That no reference's event is among the queries of its fold is
checked, not assumed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import hashing, ranking, shared
from orrery.operators import energy, kinds, models, scoring


def references(labeled: DataFrame, n_folds: int, most: int = 64, seed: int = 0) -> DataFrame:
    """(fold, kind, event_id, x): for each fold, ``most`` windows of each kind from events of other folds, by keyed hash."""
    to = labeled.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).where("fold <> own")
    h = to.select("fold", "kind", "event_id", "x", hashing.hashed(seed, F.col("event_id"), F.xxhash64("x")).alias("h"))
    return ranking.numbered(h, ["fold", "kind"], ranking.hash_bucket(F.col("h")), ["h", "event_id"]).where(F.col("index") < most).select("fold", "kind", "event_id", "x")


def assert_isolated(refs: DataFrame, queries: DataFrame) -> None:
    """Raise if an event is a reference of the fold that it is a query of."""
    if not refs.select("fold", "event_id").join(queries.select("fold", "event_id"), ["fold", "event_id"], "left_semi").isEmpty():
        raise ValueError("references and queries of a fold share an event")


def encoded(refs: DataFrame, basis: np.ndarray, centre: np.ndarray) -> dict[tuple[int, str], np.ndarray]:
    """The references of each fold and kind in the encoder's space; at most ``energy.MOST`` in all, more are an error."""
    rows = refs.select("fold", "kind", "x").limit(energy.MOST + 1).toPandas()
    if len(rows) > energy.MOST:
        raise ValueError(f"more than {energy.MOST} references")
    return {(int(f), k): (np.stack(g.x).astype(float) - centre) @ basis for (f, k), g in rows.groupby(["fold", "kind"])}


def variants(z: dict[tuple[int, str], np.ndarray], n_folds: int, base: models.Guide, proto: tuple[str, ...], lam: float) -> dict[str, models.Guide | None]:
    """Recipes ``variant|fold|slice``: unguided; stratified by kind (prototypes for ``proto``, the band for others); the mix of soft and prototypes."""
    out: dict[str, models.Guide | None] = {}
    guide = lambda a, p: models.Guide(base.basis, base.centre, base.refs, base.tau, base.q_value, base.lam, base.clip, base.mode, base.parent, base.n_correct, a, lam, p)
    for k in range(n_folds):
        out[f"unguided|{k}|all"] = None
        mine = {kind: v for (f, kind), v in z.items() if f == k}
        for kind, v in mine.items():
            out[f"stratified|{k}|{kind}"] = guide(v, True) if kind in proto else base
        if mine:
            out[f"mix|{k}|soft"] = guide(np.concatenate(list(mine.values())), False)
        for name, kind in zip(("first", "second"), proto, strict=False):
            if kind in mine:
                out[f"mix|{k}|{name}"] = guide(mine[kind], True)
    return out


def allocated(donors: DataFrame, n_folds: int, kind_names: list[str], seed: int) -> DataFrame:
    """Every donor (donor_id, channel_idx, x) once for each fold and variant, with its recipe: 60, 20 and 20 percent for the mix."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold")
    parts = [
        donors.select("donor_id", "channel_idx", "x", F.lit("unguided").alias("variant"), F.lit("all").alias("slice")),
        kinds.alloc_stratified(donors, kind_names, seed).select("donor_id", "channel_idx", "x", F.lit("stratified").alias("variant"), F.col("kind_alloc").alias("slice")),
        kinds.alloc_shares(donors, [("soft", 0.6), ("first", 0.2), ("second", 0.2)]).select("donor_id", "channel_idx", "x", F.lit("mix").alias("variant"), F.col("recipe").alias("slice")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("*", fold)
    return rows.select("donor_id", "channel_idx", "x", F.col("x").alias("parent"), F.concat_ws("|", "variant", "fold", "slice").alias("recipe"))


def scores(queries: DataFrame, made: DataFrame, target: float = 0.5) -> DataFrame:
    """(variant, fold, n_gallery, tau, coverage_anomaly, arp_anomaly, coverage_rare, arp_rare, gap).

    ``queries`` has query_id, fold, side (anomaly or rare) and x, ``made`` recipe and x. A
    fold's queries meet that fold's galleries; tau is the ``target`` quantile of all
    anomalies' distances.
    """
    name = F.split("recipe", r"\|")
    g = made.select(F.concat_ws("|", name[0], name[1]).alias("method"), "x")
    near = scoring.min_distances(queries, g, "method").join(queries.select("query_id", "fold", "side"), "query_id")
    near = shared.written(near.where(F.split("method", r"\|")[1].cast("int") == F.col("fold")), "near")
    tau = scoring.choose_tau(near.where("side = 'anomaly'"), target).first()["tau"]
    s = scoring.score_generator(near.where("side = 'anomaly'"), near.where("side = 'rare'"), tau)
    sizes = g.groupBy("method").agg(F.count("*").alias("n_gallery"))
    both = s.join(sizes, "method")
    part = F.split("method", r"\|")
    return both.select(part[0].alias("variant"), part[1].cast("int").alias("fold"), "n_gallery", F.lit(tau).alias("tau"), "coverage_anomaly", "arp_anomaly", "coverage_rare", "arp_rare", "gap")
