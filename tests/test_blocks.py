"""Blocks that meet: what a task holds, how groups are spread, and that no pair leaves a task."""

import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext

from orrery.functions import shared
from orrery.operators import blocks, energy, nearest, scoring


def rows(spark, x, key="query_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, x array<double>")


def exact(a, b):
    return ((a[:, None] - b[None]) ** 2).sum(axis=2)


@pytest.mark.parametrize("scale, shift", [(1, 0), (1e-6, 1e6), (1e150, 0), (1e200, 0)])
def test_squares_equal_differences(scale, shift):
    rng = np.random.default_rng(1)
    b = rng.normal(size=(300, 16)) * scale + shift
    a = np.concatenate([rng.normal(size=(50, 16)) * scale + shift, b[:20], b[:20] * (1 + 1e-9), b[:1] * 1e3])
    with np.errstate(all="ignore"):
        want = exact(a, b)
        assert np.allclose(blocks.squares(a, b), want, rtol=1e-9, atol=0)
        assert np.allclose(blocks.nearest(a, b), want.min(axis=1), rtol=1e-9, atol=0)
    a[3, 2], a[4, 5] = np.inf, np.nan
    got = blocks.squares(a, b)
    assert np.isinf(got[3]).all() and np.isnan(got[4]).all() and np.isfinite(got[5:10]).all() == np.isfinite(want[5:10]).all()


def in_process(monkeypatch):
    """Keeps what a group does, to run it here."""
    kept = []
    monkeypatch.setattr(blocks, "meet", lambda left, right, work, schema, *_: kept.append(work) or left.sparkSession.createDataFrame([], schema))
    return kept


def frames(n, m):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(n, 8)), rng.normal(size=(m, 8))
    return x, y, pd.DataFrame({"query_id": range(n), "x": list(x)}), pd.DataFrame({"kind": ["ab"[i % 2] for i in range(m)], "grp": "", "x": list(y)})


@pytest.mark.parametrize("what", ["energies", "direct"])
def test_a_group_holds_tiles_not_all_pairs(spark, monkeypatch, what):
    kept, (x, y, q, r) = in_process(monkeypatch), frames(3000, 20_000)
    few = rows(spark, x[:2])
    energy.energies(few, few.selectExpr("x", "1 AS kind"), 2.0, 8, "kind") if what == "energies" else nearest.direct(few, few)
    tracemalloc.start()
    got = kept[0](q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6  # all pairs of the group are 480 MB
    d2 = exact(x[:5], y[::2])
    if what == "energies":
        mine = got[(got.kind == "a") & (got.query_id < 5)]
        assert np.allclose(np.stack(mine.near), np.sort(d2, axis=1)[:, :8]) and np.allclose(mine.part, np.log(np.exp(-d2 / 2).sum(axis=1)))
    else:
        assert np.allclose(got.d2[:5], exact(x[:5], y).min(axis=1))


def test_groups_are_spread_over_tasks(spark):
    """Their bytes are few, so adaptive plans would put them all into one task."""
    x = np.random.default_rng(3).normal(size=(60, 4))
    work = lambda a, b: pd.DataFrame({"task": [TaskContext.get().partitionId()], "n": [len(a) * len(b)]})
    got = blocks.meet(rows(spark, x), rows(spark, x), work, "task int, n long", (15, 15)).toPandas()
    assert len(got) == 16 and got.n.sum() == 3600 and got.task.nunique() > 4
    flat = lambda t: pd.DataFrame({"task": [TaskContext.get().partitionId()], "n": [sum(len(v) for v in t)]})
    got = blocks.among(*blocks.numbered(rows(spark, x, "id"), "x"), flat, "task int, n long", 10).toPandas()
    assert len(got) == 21 and got.n.sum() == 60 * 59 // 2 and got.task.nunique() > 4


def test_ids_that_repeat_are_no_pair(spark):
    x = np.array([[0.0], [0.0], [3.0], [5.0]])
    table = spark.createDataFrame([(i, [float(v[0])]) for i, v in zip((1, 1, 2, 2), x, strict=True)], "query_id long, x array<double>")
    assert scoring.mean_pairwise(table).first()["diversity"] == pytest.approx((3 + 5 + 3 + 5) / 4)


def test_search_in_noise_writes_no_pairs(spark):
    """Nothing can be ruled out, so every query asks for every ring: that must not become rows."""
    rng = np.random.default_rng(4)
    q, g = rng.normal(size=(120, 40)), rng.normal(size=(400, 40))
    place = Path(shared.folder(spark))
    before = set(place.glob("orrery-*"))
    near, used = nearest.search(rows(spark, q), rows(spark, g, "donor_id"), None, 50, 8)
    got = {r["query_id"]: r["distance"] for r in near.collect()}
    assert np.allclose([got[i] for i in range(len(q))], np.sqrt(exact(q, g).min(axis=1)))
    sizes = [spark.read.parquet(str(p)).count() for p in set(place.glob("orrery-*")) - before]
    assert sum(sizes) <= 3 * (len(q) + len(g))
    u = used.first()
    assert u["pairs"] == len(q) * len(g) and u["pairs"] / 2 < u["compared"] <= u["pairs"]


def test_cells_of_a_tuning_grid_meet_queries_in_small_tiles(spark, monkeypatch):
    """What a worker holds of one group beyond its rows does not follow their product (480 MB here)."""
    kept, (x, y, q, r) = in_process(monkeypatch), frames(3000, 20_000)
    few = rows(spark, x[:2])
    nearest.direct(few, few.selectExpr("x", "'a' AS kind"), "kind")
    r["grp"] = r.kind
    tracemalloc.start()
    got = kept[0](q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    for k in "ab":
        mine = got[got.grp == k]
        assert np.allclose(mine.d2[:20], exact(x[:20], y["ab".index(k) :: 2]).min(axis=1), rtol=1e-12) and len(mine) == 3000
