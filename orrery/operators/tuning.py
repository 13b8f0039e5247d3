"""Tuning cells: settings of the sampler crossed with donors, sampled in one pass, gated, and scored out of fold.

The fold of the queries is held out: references come from the other folds, and an event
on both sides is an error. Cells whose windows are not finite, or explode, are dropped
before any distance is taken; they stay in the report with coverage and ARP 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import hashing, ranking, shared
from orrery.operators import models, oof, reports, scoring


@dataclass(frozen=True)
class Cell:
    family: str
    steps: int
    lam: float
    nu: float
    n_correct: int = 1
    unit: bool = False
    mode: str = "band"
    lam_anom: float = 0.0
    lam_rare: float = 0.0

    @property
    def id(self) -> str:
        pull = f"-a{self.lam_anom:g}-r{self.lam_rare:g}" if self.family == "contrast" else ""
        return f"{self.family}-s{self.steps}-l{self.lam:g}-n{self.nu:g}-c{self.n_correct}{'-unit' if self.unit else ''}-{self.mode}{pull}"


# The settings that are searched.
GRID = (
    Cell("zs", 20, 0.3, 0.2, 1, False, "band"),
    Cell("zs", 50, 0.3, 0.2, 1, False, "band"),
    Cell("zs", 100, 0.3, 0.2, 1, False, "band"),
    Cell("zs", 50, 0.3, 0.2, 4, False, "band"),
    Cell("zs", 50, 1.5, 0.2, 1, True, "band"),
    Cell("zs", 50, 4.0, 0.2, 1, True, "band"),
    Cell("zs", 100, 1.5, 0.2, 1, True, "band"),
    Cell("zs", 50, 1.5, 0.2, 4, True, "band"),
    Cell("zs", 50, 1.5, 0.5, 1, True, "band"),
    Cell("zs", 50, 1.5, 0.2, 1, True, "push"),
    Cell("contrast", 50, 0.0, 0.2, 1, True, "band", 1.0, 1.0),
    Cell("contrast", 50, 0.0, 0.2, 1, True, "band", 3.0, 1.0),
    Cell("contrast", 50, 0.0, 0.2, 1, True, "band", 1.0, 3.0),
    Cell("contrast", 50, 0.0, 0.2, 1, True, "band", 3.0, 3.0),
    Cell("contrast", 50, 0.3, 0.2, 1, True, "band", 1.0, 1.0),
    Cell("contrast", 50, 0.0, 0.5, 1, True, "band", 3.0, 3.0),
    Cell("contrast", 80, 0.0, 0.2, 1, True, "band", 3.0, 3.0),
)


@dataclass
class Steering(models.Guide):
    """Terms that are clipped (or first brought to length 1) one by one: the energy's, towards anomalies, away from rare events."""

    unit: bool = False
    rares: np.ndarray | None = None
    lam_rare: float = 0.0

    def bounded(self, g: np.ndarray) -> np.ndarray:
        if self.unit:
            g = g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-8)
        return np.clip(g, -self.clip, self.clip)

    def step(self, x: np.ndarray, x0: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
        for _ in range(self.n_correct):
            h, g = self.energy(x)
            move = self.lam * self.bounded(-g if self.mode == "push" else 2 * (h - self.q_value)[:, None] * g)
            if self.lam_anom and self.anomalies is not None and len(self.anomalies):
                move = move + self.lam_anom * self.bounded(self.energy(x, self.anomalies)[1])
            if self.lam_rare and self.rares is not None and len(self.rares):
                move = move - self.lam_rare * self.bounded(self.energy(x, self.rares)[1])
            x = x - move
        return x


def steerings(cells: tuple[Cell, ...], base: models.Guide, anomalies: np.ndarray, rares: np.ndarray) -> dict[str, Steering]:
    """The steering of each cell; only contrast cells see anomalies and rare events."""
    plain = Steering(base.basis, base.centre, base.refs, base.tau, base.q_value, clip=base.clip)
    return {c.id: replace(plain, lam=c.lam, mode=c.mode, n_correct=c.n_correct, unit=c.unit, anomalies=anomalies, lam_anom=c.lam_anom, rares=rares, lam_rare=c.lam_rare) for c in cells}


def sample(donors: DataFrame, model: models.Gaussians, cells: tuple[Cell, ...], steers: dict[str, Steering], schedule: models.Schedule | None = None, seed: int = 0) -> DataFrame:
    """(cell, donor_id, channel_idx, h, x): every donor (donor_id, channel_idx, x) under every cell, in one pass; h is the energy of the result.

    A donor's noise depends on its id alone, so all cells start from the same noise.
    """
    bars = (schedule or models.Schedule()).alpha_bar()
    of = {c.id: c for c in cells}
    times = {}
    for k, c in of.items():
        top = max(0, min(len(bars) - 1, round(c.nu * (len(bars) - 1))))
        times[k] = np.unique(np.linspace(0, top, max(2, c.steps)).round().astype(int))[::-1]
    noise = F.transform("x", lambda _, t: hashing.gauss(seed, F.col("donor_id"), t))
    # Without a repartition a small donor table would sample all cells in one task.
    dealt = donors.select("donor_id", "channel_idx", "x", noise.alias("e")).select("*", F.explode(F.array(*map(F.lit, of))).alias("cell")).repartition("cell", "donor_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (k, c), g in b.groupby(["cell", "channel_idx"]):
                x0, e0, steer, steps = np.stack(g.x).astype(float), np.stack(g.e).astype(float), steers[k], times[k]
                x = np.sqrt(bars[steps[0]]) * x0 + np.sqrt(1 - bars[steps[0]]) * e0
                with np.errstate(all="ignore"):  # a cell may explode: that is what the gate is for
                    for i, t in enumerate(steps):
                        e = model.noise(x, int(c), bars[t])
                        clean = steer.step((x - np.sqrt(1 - bars[t]) * e) / np.sqrt(bars[t]), x0)
                        after = bars[steps[i + 1]] if i + 1 < len(steps) else 1.0
                        x = np.sqrt(after) * clean + np.sqrt(1 - after) * e
                    h = steer.energy(x)[0]
                yield pd.DataFrame({"cell": k, "donor_id": g.donor_id, "channel_idx": g.channel_idx, "h": h, "x": list(x)})

    return dealt.mapInPandas(work, "cell string, donor_id long, channel_idx int, h double, x array<double>")


def encode(rows: DataFrame, basis: np.ndarray, centre: np.ndarray, key: str = "donor_id") -> DataFrame:
    """(query_id, x): windows in the encoder's space."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"query_id": b[key], "x": list((np.stack(b.x).astype(float) - centre) @ basis)})

    return rows.select(key, "x").mapInPandas(work, "query_id long, x array<double>")


def gated(made: DataFrame, q_value: float, delta: float, most: float = 50.0) -> DataFrame:
    """(cell, n, finite, explode, occupancy, h_mean, h_std): a cell is finite if all its windows and energies are; a cell that is not finite explodes."""
    rows = made.withColumn("x", F.array_append("x", F.when(F.col("h").isNull() | F.isnan("h") | (F.abs("h") == float("inf")), float("nan")).otherwise(0.0)))
    gate = reports.finite_gate(rows, most).withColumn("explode", ~F.col("finite") | F.col("explode"))
    band = made.groupBy("cell").agg(F.avg((F.abs(F.col("h") - q_value) <= delta).cast("double")).alias("o"), F.avg("h").alias("m"), F.stddev_pop("h").alias("s"))
    nan = F.lit(float("nan"))
    own = [F.when(F.col("finite"), F.col(c)).otherwise(d).alias(n) for c, d, n in (("o", F.lit(0.0), "occupancy"), ("m", nan, "h_mean"), ("s", nan, "h_std"))]
    return gate.join(band, "cell").select("cell", "n", "finite", "explode", *own)


def run(donors: DataFrame, queries: DataFrame, model: models.Gaussians, base: models.Guide, delta: float, tau: float | None = None, fold: int = 0, cells: tuple[Cell, ...] = GRID, n_folds: int = 3, schedule: models.Schedule | None = None, seed: int = 0) -> DataFrame:
    """A row a cell: its settings, gates, occupancy, median total variation, and coverage, ARP and mean distance of ``fold``'s anomalies and rare events.

    Without ``tau``, half of the distances of anomalies to live cells lie within it. ``queries`` has query_id, event_id, fold, side (anomaly or rare), kind and x. References
    go with the tasks and are bounded by :data:`orrery.operators.energy.MOST`.
    """
    refs = shared.written(oof.references(queries.withColumn("kind", F.col("side")), n_folds, 64, seed).where(F.col("fold") == fold), "tuning-references")
    mine = queries.where(F.col("fold") == fold)
    oof.assert_isolated(refs, mine)
    z = oof.encoded(refs, base.basis, base.centre)
    none = np.zeros((0, base.basis.shape[1]))
    steers = steerings(cells, base, z.get((fold, "anomaly"), none), z.get((fold, "rare"), none))
    made = shared.written(sample(donors, model, cells, steers, schedule, seed), "tuning-made")
    gates = shared.written(gated(made, base.q_value, delta), "tuning-gates")
    # One row a cell.
    live = made.join(F.broadcast(gates.where(~F.col("explode")).select("cell")), "cell", "left_semi").select("cell", "x")
    near = scoring.min_distances(mine.select("query_id", "x"), live.withColumnRenamed("cell", "method"), "method").join(mine.select("query_id", "side"), "query_id")
    near = shared.written(near, "tuning-near")
    if tau is None:
        tau = scoring.choose_tau(near.where("side = 'anomaly'"), 0.5).first()["tau"] if not near.where("side = 'anomaly'").isEmpty() else 0.0
    scored = scoring.score_generator(near.where("side = 'anomaly'"), near.where("side = 'rare'"), tau)
    far = near.groupBy("method").agg(*[F.avg(F.when(F.col("side") == s, F.col("distance"))).alias(f"distance_{s}") for s in ("anomaly", "rare")])
    tv = ranking.quantiles(live.select(F.col("cell").alias("method"), A.total_variation(F.col("x")).alias("tv")), "tv", [0.5], ["method"]).select("method", F.col("q")[0].alias("tv"))
    spark, inf = donors.sparkSession, F.lit(float("inf"))
    known = spark.createDataFrame([(c.id, c.family, c.steps, c.lam, c.nu, c.n_correct, c.unit, c.mode, c.lam_anom, c.lam_rare) for c in cells], "cell string, family string, steps int, lam double, nu double, n_correct int, unit boolean, mode string, lam_anom double, lam_rare double")
    rows = known.join(gates, "cell").join(scored.join(far, "method").join(tv, "method", "left").withColumnRenamed("method", "cell"), "cell", "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("coverage_anomaly", "arp_anomaly", "coverage_rare", "arp_rare", "gap")]
    return rows.select(*known.columns, *gates.columns[1:], "tv", *zero, *[F.coalesce(c, inf).alias(c) for c in ("distance_anomaly", "distance_rare")])


def winners(rows: DataFrame) -> DataFrame:
    """(goal, cell, value): the live cell with most occupancy (of the zs family), most ARP of anomalies, largest gap; the smallest id of equals, null if no cell lives."""
    live = F.col("finite") & ~F.col("explode")
    best = lambda metric, ok: F.min_by(F.struct("cell", F.col(metric).alias("value")), F.when(ok, F.struct((-F.col(metric)).alias("v"), F.col("cell").alias("c"))))
    goals = {"occupancy": best("occupancy", live & (F.col("family") == "zs")), "arp_anomaly": best("arp_anomaly", live), "gap": best("gap", live)}
    one = rows.agg(*[b.alias(g) for g, b in goals.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(g).alias("goal"), F.col(g)["cell"].alias("cell"), F.col(g)["value"].alias("value")) for g in goals])))
