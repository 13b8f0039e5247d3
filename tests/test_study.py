"""Models trained together, and the detector study."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import detection, grouped, study


def rows_of(spark, sets, dim):
    rows = [([m], int(y), [float(v) for v in x]) for m, (xs, ys) in enumerate(sets) for x, y in zip(xs, ys, strict=True)]
    return spark.createDataFrame(rows, "models array<int>, label int, f array<double>").repartition(3)


def test_models_equal_those_fitted_alone(spark):
    """The gradient of each model's own objective vanishes at its weights."""
    rng = np.random.default_rng(2)
    sets = []
    for m in range(4):
        y = (rng.random(120) < 0.3 + 0.1 * m).astype(int)
        sets.append((rng.normal(size=(120, 5)) * [1, 10, 0.1, 1, 0] + y[:, None] * [m, 0, 0.05, 1, 0], y))
    for balanced in (True, False):
        got = grouped.fit(rows_of(spark, sets, 5), 4, 1.0, balanced)
        for m, (x, y) in enumerate(sets):
            z = np.concatenate([(x - got.mean[m]) / got.scale[m], np.ones((len(x), 1))], axis=1)
            c = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum())) if balanced else np.ones(len(y))
            p = 1 / (1 + np.exp(-z @ got.weights[m]))
            slope = (c * (p - y)) @ z + np.append(got.weights[m, :-1], 0)
            assert np.abs(slope).max() < 1e-4 * len(y)
            assert np.allclose(got.score(x, m), z @ got.weights[m])
    apart = [(np.concatenate([np.full((9, 1), -1.0), np.full((9, 1), 1.0)]), np.repeat([0, 1], 9))]
    assert (np.sign(grouped.fit(rows_of(spark, apart, 1), 1).score(apart[0][0], 0)) == np.repeat([-1, 1], 9)).all()


def test_a_model_of_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        grouped.fit(rows_of(spark, [([[1.0]], [1])], 1), 1)
    with pytest.raises(ValueError):
        grouped.fit(rows_of(spark, [], 1), 2)


def windows(rng, n, width, bump=0.0):
    x = rng.normal(size=(n, width))
    if bump:
        at = rng.integers(0, width - 4, n)
        for i in range(n):
            x[i, at[i] : at[i] + 4] += bump
    return [[float(v) for v in r] for r in x]


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(7)
    real = [(f"e{i // 2}", (i // 2) % 3, "anomaly", f"k{i % 2}", x) for i, x in enumerate(windows(rng, 60, 16, 6.0))]
    real += [(f"r{i}", i % 3, "rare", "k", x) for i, x in enumerate(windows(rng, 15, 16))]
    labeled = spark.createDataFrame(real, "event_id string, fold int, side string, kind string, x array<double>")
    nominal = spark.createDataFrame(list(enumerate(windows(rng, 150, 16))), "donor_id long, x array<double>")
    made = spark.createDataFrame([("good", i, x) for i, x in enumerate(windows(rng, 150, 16, 6.0))] + [("useless", i, x) for i, x in enumerate(windows(rng, 150, 16))], "method string, donor_id long, x array<double>")
    return labeled, nominal, made


PLAN = study.Plan((study.Arm("real_only", None, True), study.Arm("good", "good", False), study.Arm("useless", "useless", False), study.Arm("both", "good", True)), 3, 2, 40, 30, 5)


def test_no_row_trains_and_tests_one_model(spark, parts):
    train, test = study.sets(PLAN, *parts, 16)
    by = lambda df: df.select(F.explode("models").alias("m"), F.xxhash64("f").alias("h"), "label").cache()
    a, b = by(train), by(test)
    assert a.join(b, ["m", "h"]).count() == 0
    n = {r["m"]: r for r in a.groupBy("m").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).collect()}
    assert len(n) == PLAN.n == 24
    for m, r in n.items():
        assert r["p"] == {0: 40, 1: 40, 2: 40, 3: 80}[m // 6] and r["n"] == 100 + 10
    t = {r["m"]: r["c"] for r in b.groupBy("m").agg(F.count("*").alias("c")).collect()}
    assert set(t.values()) == {20 + 5 + 30}


def test_good_galleries_help_and_useless_ones_do_not(spark, parts):
    scored, models = study.scores(PLAN, *parts, 16)
    rows = study.report(PLAN, scored, models, 0.1, 200).collect()
    assert len(rows) == 24 and {(r["arm"], r["fold"], r["seed"]) for r in rows} == {(a.name, f, s) for a in PLAN.arms for f in range(3) for s in range(2)}
    mean = lambda arm, c: np.mean([r[c] for r in rows if r["arm"] == arm])
    assert min(mean(a, "auroc") for a in ("real_only", "good", "both")) > 0.9 > mean("useless", "auroc")
    assert all(r["recall_low"] <= r["recall_boot"] <= r["recall_high"] and r["n_events"] == 10 for r in rows)
    one = scored.where("model = 0")
    alone = detection.evaluate(one, 0.1).first()
    r = next(r for r in rows if (r["arm"], r["fold"], r["seed"]) == ("real_only", 0, 0))
    assert all(math.isclose(alone[c], r[c]) for c in ("threshold", "recall", "far", "rare_far", "average_precision", "auroc"))
    arms = {r["arm"]: r for r in study.summary(PLAN, scored, 0.1, (("good", 0),)).collect()}
    assert set(arms) == {a.name for a in PLAN.arms} and arms["good"]["recall_median"] > arms["useless"]["recall_median"]


def test_an_event_in_two_folds_is_an_error(spark, parts):
    labeled, nominal, made = parts
    with pytest.raises(ValueError):
        study.sets(PLAN, labeled.withColumn("fold", F.floor(F.rand(1) * 3).cast("int")), nominal, made, 16)
