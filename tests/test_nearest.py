"""Nearest neighbours by rings, and selection over pairs, against all pairs."""

import numpy as np
import pytest

from orrery.operators import blocks, energy, nearest, scoring


def rows(spark, x, key="query_id", **more):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, x array<double>").repartition(3)


def exact(q, g):
    return np.sqrt(((q[:, None] - g[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("shape", ["clusters", "noise", "one point", "line"])
def test_equals_all_pairs(spark, shape):
    rng = np.random.default_rng(11)
    g = {"clusters": rng.normal(size=(40, 6))[rng.integers(0, 40, 900)] * 20 + rng.normal(size=(900, 6)) * 0.1, "noise": rng.normal(size=(900, 6)), "one point": np.ones((900, 6)), "line": np.linspace(0, 1, 900)[:, None] * np.ones(6)}[shape]
    q = np.concatenate([g[:50] + rng.normal(size=(50, 6)) * 0.05, rng.normal(size=(30, 6)) * 30, g[:5]])
    near, used = nearest.search(rows(spark, q), rows(spark, g, "donor_id"), None, 60, 40)
    got = {r["query_id"]: r["distance"] for r in near.collect()}
    assert np.allclose([got[i] for i in range(len(q))], exact(q, g).min(axis=1), atol=1e-9)
    u = used.first()
    assert u["pairs"] == len(q) * len(g) and u["compared"] <= u["pairs"]
    if shape in ("clusters", "line"):
        assert u["compared"] < u["pairs"] / 5


@pytest.mark.parametrize("block", [10, 32_768])
def test_groups_of_the_gallery(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "RIGHT", block)
    rng = np.random.default_rng(12)
    q, g = rng.normal(size=(20, 3)), rng.normal(size=(300, 3))
    table = spark.createDataFrame([("ab"[i % 2], [float(v) for v in r]) for i, r in enumerate(g)] + [(None, [0.0, 0.0, 0.0])], "method string, x array<double>")
    got = {(r["query_id"], r["method"]): r["distance"] for r in scoring.min_distances(rows(spark, q), table, "method", 7).collect()}
    for k, m in enumerate("ab"):
        assert np.allclose([got[i, m] for i in range(20)], exact(q, g[k::2]).min(axis=1))
    assert scoring.min_distances(rows(spark, q), table.limit(0), "method").count() == 0


@pytest.mark.parametrize("few", [1, 50, 10**6])
def test_median_of_pairs(spark, few):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(70, 4)), [[1e6] * 4], np.ones((20, 4))])
    d2 = np.sort((exact(x, x) ** 2)[np.triu_indices(len(x), 1)])
    assert np.isclose(energy.median_square(rows(spark, x), few), d2[(len(d2) - 1) // 2])
    assert energy.median_square(rows(spark, x[:1]), few) is None
    assert energy.median_square(rows(spark, x[-3:]), few) == 0.0


@pytest.mark.parametrize("shape", ["noise", "copies", "far clusters", "outliers", "small", "large", "shifted", "one row", "one value"])
def test_screened_rows_are_the_nearest(shape):
    """The least by differences, to the last digits, whatever single precision can tell apart."""
    rng = np.random.default_rng(21)
    b = rng.normal(size=(2500, 24))
    b = {"noise": b, "copies": np.repeat(b[:5], 500, axis=0), "far clusters": rng.normal(size=(9, 24))[rng.integers(0, 9, 2500)] * 1e5 + b * 1e-3, "outliers": b * np.where(np.arange(2500) % 700, 1, 1e9)[:, None], "small": b * 1e-160, "large": b * 1e120, "shifted": b * 1e-4 + 1e6, "one row": b[:1], "one value": np.ones((2500, 24))}[shape]
    a = np.concatenate([b[:1100] * (1 + 1e-7), rng.permutation(b)[:200] + rng.normal(size=(min(200, len(b)), 24)) * b.std(), b.mean(axis=0)[None] * 3])
    want = blocks.differences(a, b).min(axis=1)
    assert np.allclose(blocks.nearest(a, b), want, rtol=1e-12, atol=0)
    most = np.where(np.arange(len(a)) % 2, want / 2, np.inf)
    assert np.allclose(blocks.nearest(a, b, most), np.minimum(want, most), rtol=1e-12, atol=0)


def test_noise_is_not_taken_ring_by_ring(monkeypatch):
    """A block of few rows in many cells has tiny rings; where none is ruled out they are met at once, and not in double precision."""
    calls, doubles = [], []
    near, squares = blocks.nearest, blocks.squares
    monkeypatch.setattr(blocks, "nearest", lambda a, b, *more: calls.append(len(b)) or near(a, b, *more))
    monkeypatch.setattr(blocks, "squares", lambda a, b: doubles.append(len(a) * len(b)) or squares(a, b))
    rng = np.random.default_rng(22)
    q, y = rng.normal(size=(3000, 48)), rng.normal(size=(4000, 48))
    d = squares(y, y[:256])
    got, compared = nearest.within(q, y, d.argmin(axis=1), np.sqrt(d.min(axis=1)), y[:256], nearest.RING)
    assert np.allclose(got, np.sqrt(squares(q, y).min(axis=1)), rtol=1e-9)
    assert len(calls) < 20 and sum(doubles) < 0.1 * len(q) * len(y) and (compared <= len(y)).all()
