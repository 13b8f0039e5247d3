"""Archives of raw series, written with pandas and read back, and the scouting of their channels; maximin samples."""

import pickle
import zipfile

import numpy as np
import pandas as pd
import pytest

from orrery.operators import kinds
from orrery.sources import archives


class Harm:
    def __reduce__(self):
        return (print, ("ran",))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("channels")
    rng = np.random.default_rng(2)
    index = pd.date_range("2024-01-01", periods=600, freq="10s")
    made = {"a": pd.Series(rng.normal(size=600), index=index), "b": pd.Series(np.arange(600.0), index=index.tz_localize("Europe/Berlin").tz_convert("UTC"))}
    for name, s in made.items():
        with zipfile.ZipFile(f / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.pkl", pickle.dumps(s))
    (f / "a.pkl").write_bytes(pickle.dumps(made["a"] * 0))  # the zip counts
    twice = pd.Series([1.0, 2.0, np.nan, 4.0], index=pd.DatetimeIndex(["2024-01-01 00:00:10", "2024-01-01 00:00:10", "2024-01-01 00:01:00", "2024-01-01"]))
    (f / "c.pkl").write_bytes(pickle.dumps(pd.DataFrame({"z": 0.0, "c": twice})))
    (f / "d.pkl").write_bytes(pickle.dumps(pd.Series([1.0], index=pd.DatetimeIndex(["2030-01-01"]))))
    with zipfile.ZipFile(f / "e.zip", "w"):
        pass
    with zipfile.ZipFile(f / "g.zip", "w") as z:
        z.writestr("g.csv", "t,v\n2024-01-01T02:00:00+02:00,7\n")
    (f / "harm.pkl").write_bytes(pickle.dumps(Harm()))
    return str(f), made


def test_round_trip(spark, folder):
    f, made = folder
    rows = archives.read(spark, f, ["a", "b", "nowhere"]).toPandas()
    for name, s in made.items():
        got = rows[rows.channel == name].sort_values("seq")
        at = s.index.tz_localize(None) if s.index.tz else s.index
        assert got.value.to_numpy().tolist() == s.to_numpy().tolist() and (pd.DatetimeIndex(got.ts) == at).all()
    assert set(rows.channel) == {"a", "b"}
    assert archives.read(spark, f, ["nowhere"]).count() == 0


def test_columns_by_name_csv_and_repeated_times(spark, folder):
    rows = [(r["channel"], str(r["ts"]), r["seq"], r["value"]) for r in archives.read(spark, folder[0], ["c", "g", "e"]).orderBy("channel", "seq").collect()]
    assert [r[:3] for r in rows] == [("c", "2024-01-01 00:00:10", 0), ("c", "2024-01-01 00:00:10", 1), ("c", "2024-01-01 00:01:00", 2), ("c", "2024-01-01 00:00:00", 3), ("g", "2024-01-01 00:00:00", 0)]
    assert [r[3] for r in rows if r[2] != 2] == [1.0, 2.0, 4.0, 7.0]


def test_code_of_a_file_is_not_run(spark, folder, capfd):
    with pytest.raises(Exception, match="not part of a column"):
        archives.read(spark, folder[0], ["harm"]).collect()
    assert "ran" not in capfd.readouterr().out


def test_scouting_marks_what_is_missing_or_empty(spark, folder):
    rows = {r["channel"]: r for r in archives.scout(spark, folder[0], ["a", "b", "c", "d", "e", "nowhere"], "2024-01-01 02:00:00", 30, 16).collect()}
    assert {k: (r["missing"], r["empty"]) for k, r in rows.items()} == {"a": (False, False), "b": (False, False), "c": (False, False), "d": (False, True), "e": (False, True), "nowhere": (True, False)}
    y = folder[1]["a"].to_numpy().reshape(-1, 3).mean(axis=1)
    assert rows["a"]["n_windows"] == 200 - 15 and abs(rows["a"]["std"] - y.std()) < 1e-9 and rows["a"]["n_probe"] == 48
    assert abs(rows["a"]["finite_frac"] - 200 / 240) < 1e-9 and abs(rows["c"]["finite_frac"] - 1 / 240) < 1e-9
    # b starts an hour later in neither reading: its times are those of UTC, 23:00 the day before.
    assert abs(rows["b"]["finite_frac"] - 200 / 360) < 1e-9 and rows["nowhere"]["std"] is None


def brute(x, n):
    chosen = [0]
    while len(chosen) < min(n, len(x)):
        d = ((x[:, None] - x[chosen][None]) ** 2).sum(axis=2).min(axis=1)
        if d.max() <= 0:
            break
        chosen.append(int(np.flatnonzero(d == d.max())[0]))
    return chosen


@pytest.mark.parametrize("pool", [1, 7, 60, 4096])
def test_maximin_samples_equal_brute_force_whatever_the_pool(spark, pool):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, size=(300, 3)).astype(float)  # many ties and repeated rows
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "donor_id long, x array<double>").repartition(5)
    n = 6 if pool == 1 else 25
    assert [r["donor_id"] for r in kinds.farthest_points(rows, n, pool=pool).orderBy("rank").collect()] == brute(x, n)


def test_maximin_takes_fewer_passes_than_points(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(3000, 2))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "donor_id long, x array<double>")
    passes, write = [], kinds.shared.written
    monkeypatch.setattr(kinds.shared, "written", lambda df, name: passes.append(name) or write(df, name))
    assert [r["donor_id"] for r in kinds.farthest_points(rows, 40, pool=1000).orderBy("rank").collect()] == brute(x, 40)
    assert len(passes) <= 10
    assert kinds.farthest_points(rows.limit(0), 5).count() == 0
    same = spark.createDataFrame([(i, [1.0]) for i in range(9)], "donor_id long, x array<double>")
    assert kinds.farthest_points(same, 5).count() == 1
