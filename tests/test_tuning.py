"""Tuning cells against plain NumPy: sampling, gates, scores and winners."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import models, tuning
from orrery.operators.tuning import Cell

CELLS = (
    Cell("zs", 5, 0.3, 0.2),
    Cell("zs", 8, 1.5, 0.4, 2, True, "push"),
    Cell("zs", 5, 1e9, 0.2, 1, True, "push"),
    Cell("contrast", 6, 0.0, 0.2, 1, True, "band", 1.0, 0.5),
)


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6)) * 0.3
    donors = spark.createDataFrame([(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "donor_id long, channel_idx int, x array<double>")
    base = models.Guide(np.linalg.qr(rng.normal(size=(6, 2)))[0], np.zeros(6), rng.normal(size=(5, 2)), 1.0, 1.0)
    rows = [(i, f"e{i}", i % 3, "anomaly" if i % 2 else "rare", [float(v) for v in rng.normal(size=6) + 2 * (i % 2)]) for i in range(48)]
    queries = spark.createDataFrame(rows, "query_id long, event_id string, fold int, side string, x array<double>")
    return donors, models.fit_gaussians(donors), base, queries


def test_the_grid_has_both_families_and_no_setting_twice():
    assert len({c.id for c in tuning.GRID}) == len(tuning.GRID) == 17
    assert {c.family for c in tuning.GRID} == {"zs", "contrast"} and min(c.steps for c in tuning.GRID) >= 20
    assert Cell("zs", 20, 0.3, 0.2) in tuning.GRID and any(c.lam_anom > 0 < c.lam_rare for c in tuning.GRID)


def test_terms_are_bounded_one_by_one():
    rng = np.random.default_rng(1)
    z, x = rng.normal(size=(4, 2)), rng.normal(size=(7, 6))
    basis = np.linalg.qr(rng.normal(size=(6, 2)))[0]
    base = models.Guide(basis, np.zeros(6), z, 1.0, 1.0, clip=0.4)
    away = tuning.steerings((Cell("contrast", 5, 0.0, 0.2, 1, False, "band", 0.0, 2.0),), base, z[:2], z[2:])
    moved = next(iter(away.values())).step(x, x) - x
    assert np.abs(moved).max() <= 0.8 + 1e-12
    assert (base.energy(x + 1e-3 * moved, z[2:])[0] >= base.energy(x, z[2:])[0]).all()
    unit = tuning.steerings((Cell("zs", 5, 1.0, 0.2, 1, True, "push"),), models.Guide(basis, np.zeros(6), z, 1.0, 1.0, clip=9.0), z, z)
    assert np.allclose(np.linalg.norm(next(iter(unit.values())).step(x, x) - x, axis=1), 1.0)


def plain(parts, spark, cell, steer):
    """One cell without Spark but for the keyed noise."""
    donors, model, _, _ = parts
    from orrery.functions import hashing

    bars = models.Schedule().alpha_bar()
    top = round(cell.nu * (len(bars) - 1))
    times = np.unique(np.linspace(0, top, cell.steps).round().astype(int))[::-1]
    out = {}
    for r in donors.withColumn("e", F.transform("x", lambda _, t: hashing.gauss(9, F.col("donor_id"), t))).collect():
        x = np.sqrt(bars[top]) * np.array([r["x"]]) + np.sqrt(1 - bars[top]) * np.array([r["e"]])
        for i, t in enumerate(times):
            e = model.noise(x, r["channel_idx"], bars[t])
            c = steer.step((x - np.sqrt(1 - bars[t]) * e) / np.sqrt(bars[t]), x)
            after = bars[times[i + 1]] if i + 1 < len(times) else 1.0
            x = np.sqrt(after) * c + np.sqrt(1 - after) * e
        out[r["donor_id"]] = x[0]
    return out


def test_cells_equal_their_definition(spark, parts):
    donors, model, base, queries = parts
    tau, delta = 2.0, 0.5
    rows = {r["cell"]: r for r in tuning.run(donors, queries, model, base, delta, tau, 1, CELLS, 3, seed=9).collect()}
    assert set(rows) == {c.id for c in CELLS}
    q = queries.collect()
    code = lambda side: (np.array([r["x"] for r in q if r["fold"] != 1 and r["side"] == side]) - base.centre) @ base.basis
    steers = tuning.steerings(CELLS, base, code("anomaly"), code("rare"))
    for c in CELLS:
        made = plain(parts, spark, c, steers[c.id])
        x, r = np.stack(list(made.values())), rows[c.id]
        h = base.energy(x)[0]
        assert r["n"] == 40 and r["finite"] and math.isclose(r["occupancy"], np.mean(np.abs(h - 1.0) <= delta), abs_tol=1e-9)
        assert math.isclose(r["h_mean"], h.mean(), rel_tol=1e-6)
        if np.abs(x).max() > 50:
            assert r["explode"] and r["coverage_anomaly"] == r["arp_rare"] == r["gap"] == 0 and math.isinf(r["distance_anomaly"]) and r["tv"] is None
            continue
        assert not r["explode"] and math.isclose(r["tv"], np.median(np.abs(np.diff(x, axis=1)).mean(axis=1)), rel_tol=1e-6)
        for side in ("anomaly", "rare"):
            d = np.array([np.sqrt(((x - np.array(k["x"])) ** 2).sum(axis=1)).min() for k in q if k["fold"] == 1 and k["side"] == side])
            assert math.isclose(r[f"coverage_{side}"], np.mean(d <= tau), abs_tol=1e-9) and math.isclose(r[f"arp_{side}"], 1 / (1 + d.mean()), rel_tol=1e-6)
    assert sum(r["explode"] for r in rows.values()) == 1


def test_gates_and_winners(spark):
    made = spark.createDataFrame([("a", 1.0, [1.0, 2.0]), ("a", 1.2, [0.0, 0.0]), ("b", float("nan"), [1.0, 1.0]), ("c", 1.0, [51.0, 0.0]), ("d", 1.0, [float("inf"), 0.0])], "cell string, h double, x array<double>")
    got = {r["cell"]: (r["finite"], r["explode"], round(r["occupancy"], 3)) for r in tuning.gated(made, 1.0, 0.1).collect()}
    assert got == {"a": (True, False, 0.5), "b": (False, True, 0.0), "c": (True, True, 1.0), "d": (False, True, 0.0)}
    schema = "cell string, family string, finite boolean, explode boolean, occupancy double, arp_anomaly double, gap double"
    rows = spark.createDataFrame([("p", "zs", True, False, 0.2, 0.3, 0.01), ("q", "zs", True, False, 0.8, 0.2, -0.02), ("r", "contrast", True, False, 0.9, 0.5, 0.04), ("s", "contrast", True, False, 0.1, 0.5, 0.04), ("t", "zs", False, True, 1.0, 0.9, 1.0)], schema)
    assert {r["goal"]: (r["cell"], r["value"]) for r in tuning.winners(rows).collect()} == {"occupancy": ("q", 0.8), "arp_anomaly": ("r", 0.5), "gap": ("r", 0.04)}
    assert {r["goal"]: r["cell"] for r in tuning.winners(rows.where("explode")).collect()} == {"occupancy": None, "arp_anomaly": None, "gap": None}
