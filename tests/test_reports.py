"""Helpers of reports, models and files on small inputs with known results."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import ranking
from orrery.operators import blocks, detection, energy, fidelity, folds, inject, kinds, models, reports, scaling, scoring
from orrery.sources import files


def vectors(spark, rows, name="query_id"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], f"{name} long, x array<double>")


def test_quantiles_and_numbers_equal_a_sort(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=400), np.repeat(1.5, 300), [1e9, -1e9]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(9999, None)], "id long, v double")
    r = ranking.quantiles(df, "v", [0.0, 0.1, 0.5, 0.933, 1.0]).first()
    assert r["n"] == len(v) and np.allclose(r["q"], np.quantile(v, [0.0, 0.1, 0.5, 0.933, 1.0]))
    assert ranking.quantiles(df.limit(0), "v", [0.5]).first()["q"] == [None]
    order = sorted(range(len(v)), key=lambda i: (v[i], i))
    rows = df.where("v IS NOT NULL").withColumn("all", F.lit(0))
    got = {x["id"]: x["index"] for x in ranking.numbered(rows, ["all"], ranking.number_bucket(rows, "v", 16), ["v", "id"]).collect()}
    assert got == {i: k for k, i in enumerate(order)}
    low = spark.createDataFrame([(1.0, 2), (2.0, 3), (7.0, 1)], "v double, c long")
    assert ranking.lower_median(low, "v", "c").first()["v"] == 2.0 and ranking.lower_median(low.limit(0), "v", "c").first()["v"] is None


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEFT", 3)
    rng = np.random.default_rng(5)
    q, g = rng.normal(size=(10, 4)), rng.normal(size=(17, 4))
    a, b = vectors(spark, enumerate(q)), vectors(spark, enumerate(g), "donor_id")
    want = np.sqrt(((q[:, None] - g[None]) ** 2).sum(axis=2))
    assert np.allclose([r["distance"] for r in scoring.min_distances(a, b).orderBy("query_id").collect()], want.min(axis=1))
    assert all(r["distance"] == math.inf for r in scoring.min_distances(a, b.limit(0)).collect())
    pairs = np.sqrt(((q[:, None] - q[None]) ** 2).sum(axis=2))[np.triu_indices(10, 1)]
    assert math.isclose(scoring.mean_pairwise(a).first()[0], pairs.mean()) and scoring.mean_pairwise(a.limit(1)).first()[0] == 0.0
    e = {r["query_id"]: r for r in energy.energies(a, b, 2.0, 3).collect()}
    for i in range(10):
        d2 = np.sort(want[i] ** 2)
        assert math.isclose(e[i]["soft"], -2 * np.log(np.exp(-d2 / 2).sum()), rel_tol=1e-9) and math.isclose(e[i]["knn"], -2 * np.log(np.exp(-d2[:3] / 2).sum()), rel_tol=1e-9)
    assert all(r["soft"] == math.inf for r in energy.energies(a, b.limit(0), 2.0).collect())


def test_greedy_matches(spark):
    q = spark.createDataFrame([("k", 1, [0.0]), ("k", 2, [0.1]), ("m", 3, [5.0])], "kind_name string, query_id long, x array<double>")
    g = spark.createDataFrame([("k", 10, [0.05]), ("k", 11, [0.3]), ("k", 12, [9.0]), ("z", 13, [5.0])], "kind_name string, donor_id long, x array<double>")
    assert sorted((r["query_id"], r["donor_id"]) for r in kinds.nearest_generated(q, g).collect()) == [(1, 10), (2, 11)]


def test_permuted_labels_tell_alike_from_unlike(spark):
    rng = np.random.default_rng(6)

    def side(shift, base):
        return spark.createDataFrame([(0, i // 2, base + i, [float(v) for v in rng.normal(shift, 1, 8)]) for i in range(160)], "channel_idx int, group_id long, window_id long, x array<double>")

    same = fidelity.c2st(side(0, 0), side(0, 0), n_perm=60).collect()
    far = fidelity.c2st(side(0, 0), side(2, 0), n_perm=60).collect()
    assert sorted(r["seed"] for r in same) == sorted(r["seed"] for r in far) == list(range(5))
    assert all(r["accuracy"] > 0.9 and r["p_value"] < 0.05 for r in far)
    assert all(abs(r["accuracy"] - 0.5) < 0.2 for r in same) and sum(r["p_value"] < 0.05 for r in same) <= 2
    assert all(r["n_train"] + r["n_test"] == 320 for r in same + far)
    groups = side(0, 0).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    assert fidelity.test_groups(groups, 0.3).count() == 2 * math.ceil(0.3 * 80)
    assert fidelity.c2st(side(0, 0), side(0, 0).limit(0)).count() == 0


def test_null_share_equals_dealing_labels(spark):
    rng = np.random.default_rng(8)
    label, said = rng.permutation(np.repeat([1, 0], [40, 60])), rng.random(100) < 0.4
    value = lambda y: (said[y == 1].mean() + (~said)[y == 0].mean()) / 2
    dealt = np.mean([value(rng.permutation(label)) >= value(label) - 1e-12 for _ in range(20_000)])
    p = fidelity.null_share(int(said[label == 1].sum()), int(said.sum()), 40, 60, 20_000, 1)
    assert abs(p - dealt) < 0.02


def test_one_outlier_does_not_fill_a_bucket(spark):
    v = [float(i) for i in range(6400)] + [1e12, -1e12]
    counts = spark.createDataFrame([("g", x, 1) for x in v], "g string, v double, c long")
    at = ranking.below(counts, ["g"], "v", ["c"])
    assert {r["v"]: r["c_below"] for r in at.collect()} == {x: i for i, x in enumerate(sorted(v))}
    cuts = counts.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000)).first()[0]
    assert max(np.bincount(np.searchsorted(cuts, v))) < 2 / 64 * len(v)
    two = counts.unionByName(counts.select(F.lit("h").alias("g"), (F.col("v") / 1000).alias("v"), "c"))
    q = {r["g"]: r["q"] for r in ranking.quantiles(two, "v", [0.25, 0.5], ["g"]).collect()}
    assert np.allclose(q["g"], np.quantile(v, [0.25, 0.5])) and np.allclose(q["h"], np.quantile(v, [0.25, 0.5]) / 1000)


def test_counts_gates_and_picks(spark):
    rows = spark.createDataFrame([("a", 0, 1, [0.0, 3.0]), ("a", 0, 2, [0.0, 1.0]), ("b", 1, 3, [float("nan"), 99.0]), ("c", 1, 4, [0.0, 99.0])], "cell string, channel_idx int, donor_id long, x array<double>")
    got = {r["cell"]: (r["n"], r["finite"], r["explode"]) for r in reports.finite_gate(rows).collect()}
    assert got == {"a": (2, True, False), "b": (1, False, False), "c": (1, True, True)}
    assert {r["donor_id"] for r in reports.one_per_channel(rows, 9).collect()} == {1, 3}
    assert reports.pick_mixed(rows, 3).count() == 3 and reports.subsample(rows, 2).count() == 2
    every = spark.createDataFrame([("a",), ("z",)], "cell string")
    assert {r["cell"]: r["n"] for r in reports.counts(rows, "cell", every).collect()} == {"a": 2, "z": 0}
    keys = spark.createDataFrame([("r", "x", 2.0)], "run string, key string, value double")
    asked = spark.createDataFrame([("r", "x"), ("r", "y")], "run string, key string")
    assert {r["key"]: r["value"] for r in reports.metric_lookup(keys, asked).collect()} == {"x": 2.0, "y": None}
    lam = rows.select("cell", reports.slice_strength(F.col("cell"), ["a"], 0.3).alias("s")).distinct()
    assert {r["cell"]: tuple(r["s"]) for r in lam.collect()} == {"a": (True, 1.0), "b": (False, 0.3), "c": (False, 0.3)}


def test_window_functions_of_constant_windows(spark):
    r = vectors(spark, [(0, [2, 2, 2, 2])]).select(A.acf(F.col("x"), 3).alias("a"), A.shape_scores(F.col("x"), F.col("x")).alias("s")).first()
    assert r["a"] == [1.0, 0.0, 0.0] and tuple(r["s"]) == (0.0, 0.0)


def test_scaler_inverse_and_leash(spark):
    rows = spark.createDataFrame([(0, [1.0, 3.0, 2.0])], "channel_idx int, x array<double>")
    s = scaling.fit_minmax(rows, spark.createDataFrame([("a", 0)], "channel string, channel_idx int"))
    assert scaling.inverse(scaling.transform(rows, s, (-1.0, 1.0)), s, (-1.0, 1.0)).first()["x"] == [1.0, 3.0, 2.0]


def test_inflation_of_one_is_the_projection(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 12)) + 4
    rows = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "donor_id long, channel_idx int, x array<double>")
    model = models.fit_gaussians(rows)
    for psi, patch, same in ((1.0, None, True), (1.0, 0.2, True), (6.0, None, False), (6.0, 1e9, True)):
        got = np.array([r["x"] for r in models.ppca_inflate(rows, model, psi=psi, latent=2 if not same else 4, patch=patch).orderBy("donor_id").collect()])
        assert np.allclose(got, x, atol=1e-4) == same


def test_supervised_contrast_and_time_embedding(spark):
    z = np.array([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]])
    assert models.supcon_loss(z, np.array([0, 0, 1, 1])) < models.supcon_loss(z, np.array([0, 1, 0, 1]))
    e = spark.range(1).select(models.time_embedding(F.lit(0.0), 8).alias("e")).first()["e"]
    assert e == [0.0] * 4 + [1.0] * 4


def test_assertions_raise(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,)], "id long")
    with pytest.raises(ValueError, match="overlap"):
        detection.assert_disjoint(a, b, "id")
    detection.assert_disjoint(a.where("id = 1"), b, "id")
    with pytest.raises(ValueError, match="fewer"):
        inject.donors(spark.createDataFrame([(0, 1, [1.0])], "channel_idx int, start long, x array<double>"), 2, 0)


def test_means_over_folds_skip_nan(spark):
    rows = spark.createDataFrame([("m", 1.0), ("m", float("nan")), ("m", 3.0), ("m", None)], "method string, v double")
    assert folds.fold_means(rows, ["method"], ["v"]).first()["v"] == 2.0
    assert math.isnan(fidelity.macro(rows.limit(0), "v").first()["value"])


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2], "x y/z")], "b int, a array<int>, k string")
    files.write_rows(rows, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["a", "b", "k"]
    files.write_report(str(tmp_path / "r.json"), {"ok": True, "n": 3})
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 3, "ok": True}
    assert rows.select(files.clean_key(F.col("k")).alias("k")).first()["k"] == "x_y_z"


def test_prototype_energy(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.0], [0.0, 0.0])], "query_id long, x array<double>, proto array<double>")
    assert energy.proto_energy(rows).first()["energy"] == 4.0


def test_report_quantiles_with_an_outlier(spark):
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.normal(size=300), [1e12]])
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("a", math.nan), ("b", 2.0), (None, 7.0)], "source string, m double")
    got = {r["source"]: r for r in reports.diagnostics(df, ["source"], ["m"]).collect()}
    assert np.allclose([got["a"][c] for c in ("p05", "median", "p95")], np.quantile(v, [0.05, 0.5, 0.95])) and got["a"]["n"] == 301
    assert got["b"]["median"] == 2.0 and got[None]["n"] == 1 and got[None]["median"] is None
    share = {r["m"]: r["share"] for r in reports.ecdf(df.where("source = 'a' AND NOT isnan(m)"), "source", "m").collect()}
    assert all(math.isclose(share[x], (v <= x).mean()) for x in v.tolist())
    at = ranking.below(spark.createDataFrame([(float(x), 1) for x in v], "v double, c long"), [], "v", ["c"])
    assert sorted((r["v"], r["c_below"]) for r in at.collect()) == [(x, i) for i, x in enumerate(sorted(v.tolist()))]
    x = [[0.0, 1.0, 3.0], [0.0, 5.0, 0.0], [2.0, 2.0, 2.0]]
    s = reports.slice_metrics(spark.createDataFrame([("k", w) for w in x], "kind_alloc string, x array<double>")).first()
    assert s["n"] == 3 and s["amp_median"] == 3.0 and s["shift_median"] == 2.0
    assert reports.slice_metrics(spark.createDataFrame([], "kind_alloc string, x array<double>")).count() == 0


def test_metrics_of_methods_equal_those_of_each(spark):
    rng = np.random.default_rng(13)

    def side(n, shift, channels):
        return [(i, c, [float(v) for v in rng.normal(shift, 1, 24)]) for c in channels for i in range(n)]

    real = spark.createDataFrame(side(9, 0, (0, 1)), "donor_id long, channel_idx int, x array<double>")
    made = [("p", *r) for r in side(7, 1, (0, 1))] + [("q", *r) for r in side(5, 2, (1, 2))]
    synth = spark.createDataFrame(made, "family string, donor_id long, channel_idx int, x array<double>")
    got = {(r["method"], r["channel_idx"], r["metric"]): r["value"] for r in fidelity.method_metrics(real, synth, "family").collect()}
    want = {}
    for m in ("p", "q"):
        one = synth.where(F.col("family") == m)
        want |= {(m, r["channel_idx"], "w1"): r["w1"] for r in fidelity.marginal_w1(real, one).collect()}
        want |= {(m, r["channel_idx"], "acd"): r["acd"] for r in fidelity.autocorrelation_difference(real, one, 16).collect()}
    assert set(got) == set(want) == {(m, c, k) for m, c in (("p", 0), ("p", 1), ("q", 1)) for k in ("w1", "acd")}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
