"""Operators on small inputs with known results."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import spectral
from orrery.operators import detection, panel, scaling
from orrery.sources import files
from orrery.streaming import panel as stream

T0 = dt.datetime(2001, 1, 1)


def windows(spark, *rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, x array<double>")


def test_bins_stop_before_the_cut(spark):
    raw = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=30 * i), 99.0 if i >= 17 else 1.0, i) for i in range(20)], "channel string, ts timestamp_ntz, value double, event_id long")
    rows = panel.mean_bins(raw, 60, "2001-01-01 00:08:00").collect()
    assert len(rows) == 8 and max(r["y"] for r in rows) < 90


def test_bins_of_an_empty_table(spark):
    assert panel.mean_bins(spark.createDataFrame([], "channel string, ts timestamp_ntz, value double"), 60, "2001-01-01 00:08:00").count() == 0


def test_planted_sine_is_found(spark):
    t = np.arange(128)
    df = windows(spark, 0.1 * np.sin(2 * np.pi * 5 * t / 128), 0.25 * np.sin(2 * np.pi * 5 * t / 128))
    rows = [r["p"] for r in df.select("id", spectral.dominant("x").alias("p")).orderBy("id").collect()]
    assert [r["bin"] for r in rows] == [5, 5] and np.allclose([r["amplitude"] for r in rows], [0.1, 0.25])


def test_power_equals_the_definition(spark):
    v = np.array([1.0, 4.0, -2.0, 0.5, 3.0, 3.0, 0.0, 1.0])
    got = windows(spark, v).select(spectral.power("x").alias("p")).first()["p"]
    want = [abs(sum(x * np.exp(-2j * np.pi * k * n / 8) for n, x in enumerate(v))) ** 2 for k in range(5)]
    assert np.allclose(got, want)


def test_step_and_bump(spark):
    step = [0.0] * 32 + [1.0] * 96
    bump = [1.0 if 48 <= t < 64 else 0.0 for t in range(128)]
    rows = windows(spark, step, bump).select(A.cusum(F.col("x")).alias("c"), A.persistence(F.col("x")).alias("p")).collect()
    assert abs(rows[0]["c"]["split"] - 0.25) < 0.02
    assert [r["p"] for r in rows] == [1.0, 0.0]


def test_quantile_and_moments(spark):
    x = [5.0, 1.0, 4.0, 2.0]
    r = windows(spark, x).select(A.quantile(F.col("x"), 0.5).alias("q"), A.std(F.col("x")).alias("s"), A.total_variation(F.col("x")).alias("tv")).first()
    assert r["q"] == 3.0 and math.isclose(r["s"], np.std(x)) and math.isclose(r["tv"], np.abs(np.diff(x)).sum() / 3)


def test_empty_channel_gets_the_unit_range(spark):
    rows = spark.createDataFrame([(0, [1.0, 3.0])], "channel_idx int, x array<double>")
    channels = spark.createDataFrame([("a", 0), ("b", 1)], "channel string, channel_idx int")
    got = {r["channel_idx"]: (r["lo"], r["hi"]) for r in scaling.fit_minmax(rows, channels).collect()}
    assert got == {0: (1.0, 3.0), 1: (0.0, 1.0)}


def test_panel_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0, T0, 1.5, 2), ("b", 1, 0, T0, None, 0)], files.PANEL)
    files.write_panel(rows, str(tmp_path / "p"))
    back = files.read_panel(spark, str(tmp_path / "p"), "2001-01-02 00:00:00")
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert files.read_panel(spark, str(tmp_path / "p"), "2001-01-01 00:00:00").count() == 0


def test_missing_types_are_an_empty_table(spark, tmp_path):
    assert files.read_types_or_none(spark, str(tmp_path / "none.csv")).count() == 0


def test_times_with_and_without_offsets(spark, tmp_path):
    (tmp_path / "l.csv").write_text("ID,Channel,StartTime,EndTime\na,c,2001-01-01T01:00:00Z,2001-01-01 03:00:00\nb,c,2001-01-01T01:00:00+02:00,\n")
    rows = {r["ID"]: r for r in files.read_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert rows["a"]["StartTime"] == dt.datetime(2001, 1, 1, 1) and rows["a"]["EndTime"] == dt.datetime(2001, 1, 1, 3)
    assert rows["b"]["StartTime"] == dt.datetime(2000, 12, 31, 23) and rows["b"]["EndTime"] is None


def test_streamed_bins_equal_batch(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(minutes=10 * i), float(i)) for i in range(12)] + [("a", T0 + dt.timedelta(days=2), 0.0)]
    df = spark.createDataFrame(rows, "channel string, ts timestamp_ntz, value double")
    df.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.mean_bins(live, 3600).writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["ts"], r["y"], r["cnt"]) for r in spark.table("bins").collect())
    assert got == [(T0, 2.5, 6), (T0 + dt.timedelta(hours=1), 8.5, 6)]


def test_auroc_of_perfect_and_inverted_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], "label int, score double")
    assert detection.auroc(df).first()[0] == 1.0
    assert detection.auroc(df.withColumn("score", -F.col("score"))).first()[0] == 0.0


def test_events_hit_by_any_window(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 0.0), ("c", 0.5)], "event_id string, score double")
    assert {r["event_id"]: r["hit"] for r in detection.event_hits(df, 1.0).collect()} == {"a": 1, "b": 0, "c": 0}
