"""Recipes by donor, out-of-fold isolation, locality, noise error, snap statistics and the gallery store."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import energy, kinds, models, oof, panel
from orrery.sources import galleries

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)) @ rng.normal(size=(8, 8)) * 0.3
    rows = spark.createDataFrame([(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "donor_id long, channel_idx int, x array<double>")
    basis = np.linalg.qr(rng.normal(size=(8, 3)))[0]
    return rows, models.fit_gaussians(rows), models.Guide(basis, np.zeros(8), rng.normal(size=(5, 3)), 1.0, 1.0, 0.2)


def result(df):
    return {(r["donor_id"], r["recipe"]): (r["channel_idx"], np.round(r["x"], 9).tolist()) for r in df.collect()}


def test_donors_keep_their_windows_in_any_order(spark, made):
    rows, model, base = made
    far = models.Guide(base.basis, base.centre, base.refs, 1.0, 1.0, 0.2, anomalies=np.full((2, 3), 4.0), lam_anom=1.0, proto=True)
    alloc = kinds.alloc_stratified(rows, ["p", "q", "none", "lost"], 0).select("donor_id", "channel_idx", "x", F.col("x").alias("parent"), F.col("kind_alloc").alias("recipe"))
    recipes = {"p": far, "q": base, "none": None}
    one = result(models.ddim_recipes(alloc.coalesce(1).orderBy("donor_id"), model, recipes, nu=0.3, seed=1))
    two = result(models.ddim_recipes(alloc.repartition(5).sortWithinPartitions(F.desc("donor_id")), model, recipes, nu=0.3, seed=1))
    assert one == two and {k[1] for k in one} == set(recipes) and len(one) == alloc.where("recipe <> 'lost'").count()
    plain = {r["donor_id"]: np.round(r["x"], 9).tolist() for r in models.ddim(models.with_parent(rows), model, nu=0.3, seed=1).collect()}
    assert all(v[1] == plain[k[0]] for k, v in one.items() if k[1] == "none")
    guided = {r["donor_id"]: np.round(r["x"], 9).tolist() for r in models.ddim(models.with_parent(rows), model, nu=0.3, seed=1, guide=base).collect()}
    assert all(v[1] == guided[k[0]] for k, v in one.items() if k[1] == "q")
    reach = lambda x: np.linalg.norm(np.array(x) @ base.basis - 4.0)
    mine = [k for k in one if k[1] == "p"]
    assert np.mean([reach(one[k][1]) for k in mine]) < np.mean([reach(guided[k[0]]) for k in mine])


def test_shares_of_donors(spark, made):
    got = [r["recipe"] for r in kinds.alloc_shares(made[0].limit(37), [("a", 0.6), ("b", 0.2), ("c", 0.2)]).orderBy("donor_id").collect()]
    assert got == ["a"] * 22 + ["b"] * 7 + ["c"] * 8


def test_a_leaked_reference_raises(spark):
    rows = [(f"e{i}", i % 3, "k" if i % 2 else "l", [float(i), 0.0]) for i in range(30)]
    labeled = spark.createDataFrame(rows, "event_id string, fold int, kind string, x array<double>")
    refs = oof.references(labeled, 3, 4, 0)
    oof.assert_isolated(refs, labeled)
    own = {r[0]: r[1] for r in rows}
    got = refs.collect()
    assert all(own[r["event_id"]] != r["fold"] for r in got) and len(got) == 3 * 2 * 4
    leaked = refs.unionByName(labeled.where("event_id = 'e0'").select("fold", "kind", "event_id", "x"))
    with pytest.raises(ValueError):
        oof.assert_isolated(leaked, labeled)


def test_locality_equals_finite_differences(spark):
    rng = np.random.default_rng(5)
    x, refs, basis, centre = rng.normal(size=(6, 20)), rng.normal(size=(50, 20)), np.linalg.qr(rng.normal(size=(20, 3)))[0], rng.normal(size=20)
    table = lambda v, k: spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], f"{k} long, x array<double>")
    got = {r["query_id"]: r["share"] for r in energy.locality(table(x, "query_id"), table(refs, "id"), basis, centre, 2.0).collect()}
    z = (refs - centre) @ basis
    h = lambda v: -2.0 * np.log(np.exp(-((((v - centre) @ basis) - z) ** 2).sum(axis=1) / 2.0).sum())
    for i, v in enumerate(x):
        g2 = np.array([(h(v + 1e-5 * e) - h(v - 1e-5 * e)) / 2e-5 for e in np.eye(20)]) ** 2
        assert abs(got[i] - np.sort(g2)[-2:].sum() / g2.sum()) < 1e-5
    assert energy.locality(table(x, "query_id"), table(refs[:0], "id"), basis, centre, 2.0).count() == 0


def test_noise_error_falls_where_covariance_helps(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 1)) + 0.05 * rng.normal(size=(400, 6))
    rows = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(base)], "donor_id long, channel_idx int, x array<double>")
    apart = models.noise_error_apart(rows, rows, seed=1).orderBy("lo").collect()
    joint = models.noise_error(models.fit_gaussians(rows), rows, seed=1).orderBy("lo").collect()
    assert [(r["lo"], r["hi"]) for r in apart] == [(25 * i, 25 * i + 25) for i in range(8)] and sum(r["n"] for r in apart) == 400
    assert [r["n"] for r in apart] == [r["n"] for r in joint] and all(j["mse"] < a["mse"] for a, j in zip(apart, joint, strict=True))
    odd = models.error_by_time(spark.createDataFrame([(t, 1.0) for t in range(10)], "t int, mse double"), 10, 4).orderBy("lo").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in odd] == [(0, 2, 2), (2, 5, 3), (5, 7, 2), (7, 10, 3)]


def test_snap_of_stepped_and_smooth_channels(spark):
    y = {"a": [float(i % 3) for i in range(40)], "b": [i * 1.37 for i in range(40)], "c": [None] * 40}
    rows = [(c, k, i, T0 + dt.timedelta(hours=i), v, int(v is not None)) for k, (c, vs) in enumerate(y.items()) for i, v in enumerate(vs)]
    p = spark.createDataFrame(rows, "channel string, channel_idx int, bin long, ts timestamp_ntz, y double, cnt int")
    got = {r["channel"]: tuple(r)[1:] for r in panel.snap_report(p, 36, 3).collect()}
    assert got["a"] == (3, 3.0, 1.0, 3) and got["b"] == (3, 36.0, 0.0, 40) and got["c"] == (0, 0.0, 0.0, 0)


def test_gallery_store_tells_what_is_missing_and_reads_what_is_asked(spark, tmp_path):
    at = str(tmp_path / "store")
    assert galleries.load(spark, at, [("a", 0)])[0].count() == 0
    rows = spark.createDataFrame([(i, 0, [float(i)], m, f) for i in range(6) for m, f in (("a", 0), ("a", 1), ("b", None))], "donor_id long, channel_idx int, x array<double>, method string, fold int")
    galleries.save(rows, at)
    got, missing = galleries.load(spark, at, [("a", 0), ("a", 2), ("b", 1), ("c", 0), ("a", 0)])
    assert {(r["method"], r["fold"]) for r in missing.collect()} == {("a", 2), ("c", 0)}
    assert {(r["method"], r["fold"]): r["n"] for r in got.groupBy("method", "fold").agg(F.count("*").alias("n")).collect()} == {("a", 0): 6, ("b", 1): 6}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "method" in plan.split("PartitionFilters: [")[1].split("]")[0]
    galleries.save(rows.where("method = 'a' AND fold = 0").withColumn("x", F.array(F.lit(9.0))), at)
    again = galleries.load(spark, at, [("a", 0), ("a", 1)])[0].collect()
    assert len(again) == 12 and {tuple(r["x"]) for r in again if r["fold"] == 0} == {(9.0,)}
