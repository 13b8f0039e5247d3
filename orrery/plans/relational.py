"""Queries of the relational core: panel, events, windows, folds, kinds, scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import events as E
from orrery.operators import folds, kinds, panel, scaling, windows
from orrery.plans import bindings as B
from orrery.plans.registry import query

W, T = B.WIDTH, B.table


@query(f"WITH {B.GRID} SELECT channel, channel_idx, bin, ts, round(y, 6) AS y, CAST(cnt AS BIGINT) AS cnt FROM panel")
def panel_mean_bins(spark, d):
    return B.grid(spark, d).withColumn("y", F.round("y", 6))


@query(f"WITH {B.GRID} SELECT channel, CASE channel WHEN 'view' THEN 0 ELSE 1 END AS channel_idx, bin, round(y, 6) AS y FROM panel WHERE channel IN ('view', 'click')")
def panel_channel_slice(spark, d):
    return panel.slice_channels(B.grid(spark, d), ["view", "click"]).select("channel", "channel_idx", "bin", F.round("y", 6).alias("y"))


@query("SELECT channel, ts, value FROM (SELECT event_type AS channel, date_trunc('hour', ts) AS ts, value, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def raw_dedupe_keep_last(spark, d):
    hours = B.raw(spark, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return panel.dedupe_keep_last(hours, "event_id")


@query(f"WITH {B.GRID} SELECT channel, count(*) AS n_bins, max(ts) AS last_ts, CAST(sum(cnt) AS BIGINT) AS n_samples FROM panel WHERE ts < TIMESTAMP '{B.PATH_END}' GROUP BY 1")
def sealed_crop_counts(spark, d):
    return panel.crop(B.grid(spark, d), B.PATH_END).groupBy("channel").agg(F.count("*").alias("n_bins"), F.max("ts").alias("last_ts"), F.sum("cnt").alias("n_samples"))


@query(f"WITH {B.GRID} SELECT event_id, CAST(greatest(0, least(n, ceil((epoch(raw.ts) - epoch(t0)) / {B.BIN}))) AS INTEGER) AS lo, CAST(greatest(0, least(n, floor((epoch(raw.ts) - epoch(t0)) / {B.BIN}) + 1)) AS INTEGER) AS hi FROM raw, size")
def time_to_index(spark, d):
    t0, n = B.bounds(B.grid(spark, d))
    first = F.lit(t0).cast("timestamp_ntz")
    return B.raw(spark, d).select("event_id", panel.bin_index(F.col("ts"), first, B.BIN, n, "left").alias("lo"), panel.bin_index(F.col("ts"), first, B.BIN, n, "right").alias("hi"))


@query(f"WITH {B.FINITE} SELECT channel, start, round({B.AMP}, 6) AS amplitude, round({B.SHIFT}, 6) AS level_shift FROM finite")
def finite_window_starts(spark, d):
    from orrery.functions import arrays as A

    return B.finite(spark, d).select("channel", "start", F.round(A.amplitude(F.col("x")), 6).alias("amplitude"), F.round(A.level_shift(F.col("x")), 6).alias("level_shift"))


@query(f"""WITH {B.FINITE},
a AS (SELECT channel, round(avg(CAST(cnt > 0 AS INTEGER)), 6) AS finite_frac, round(stddev_pop(y), 6) AS std, round(max(y) - min(y), 6) AS ptp FROM panel GROUP BY 1),
w AS (SELECT channel, count(*) AS n, avg(len(list_distinct(list_transform(x, lambda v: round(v, 6)))) / {W}.0) AS u FROM finite GROUP BY 1)
SELECT channel, finite_frac, std, ptp, coalesce(n, 0) AS n_windows, round(coalesce(u, 0.0), 6) AS unique_frac FROM a LEFT JOIN w USING (channel)""")
def channel_scout_stats(spark, d):
    r = panel.window_report(B.grid(spark, d), W)
    return r.select("channel", *[F.round(c, 6).alias(c) for c in ("finite_frac", "std", "ptp", "unique_frac")], "n_windows")


@query(f"""WITH {B.FINITE},
pr AS (SELECT channel, x, list_sort(list_distinct(list_transform(x, lambda v: round(v, 6)))) AS u FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY {B.h(B.SEED, 'channel_idx', 'start')}, start) AS k FROM finite) WHERE k <= 48),
g AS (SELECT channel, x, u, 0.25 * greatest(CASE WHEN len(u) > 1 THEN list_min(list_transform(range(1, len(u)), lambda i: u[i + 1] - u[i])) ELSE 1e-6 END, 1e-9) AS room FROM pr),
sn AS (SELECT channel, len(u) AS k, CASE WHEN len(u) <= 32 THEN len(list_filter(x, lambda v: list_min(list_transform(u, lambda k: abs(v - k))) <= room)) / {W}.0 ELSE 0 END AS snap FROM g),
p AS (SELECT channel, count(*) AS n, quantile_cont(k, 0.5) AS m, avg(snap) AS s FROM sn GROUP BY 1),
e AS (SELECT channel, count(DISTINCT round(y, 6)) FILTER (cnt > 0) AS n_unique_all FROM panel GROUP BY 1)
SELECT channel, coalesce(n, 0) AS n_probe, round(coalesce(m, 0.0), 6) AS median_unique_per_win, round(coalesce(s, 0.0), 6) AS mean_snap, n_unique_all FROM e LEFT JOIN p USING (channel)""")
def channel_snap_stats(spark, d):
    r = panel.snap_report(B.grid(spark, d), W, 48, B.SEED)
    return r.select("channel", "n_probe", *[F.round(c, 6).alias(c) for c in ("median_unique_per_win", "mean_snap")], "n_unique_all")


def _orders(spark, d):
    li, o = T(spark, d, "lineitem"), T(spark, d, "orders")
    labels = li.select(F.col("l_orderkey").alias("ID"), F.col("l_returnflag").alias("Channel"), F.col("l_shipdate").alias("StartTime"), (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int"))).alias("EndTime"))
    p = F.substring("o_orderpriority", 1, 1)
    types = o.select(
        F.col("o_orderkey").alias("ID"),
        F.when(F.col("o_orderstatus") == "F", "Anomaly").when(F.col("o_orderstatus") == "O", "Rare Event").otherwise("Communication Gap").alias("Category"),
        F.when(p.isin("1", "2"), "Point").otherwise("Subsequence").alias("Length"),
        F.when(p.isin("1", "3"), "Local").otherwise("Global").alias("Locality"),
    )
    return labels, types


_ORDERS = """frag AS (SELECT l_orderkey AS ID, l_returnflag AS Channel, l_shipdate AS StartTime, l_shipdate + to_days(CAST(trunc(l_quantity) AS INTEGER)) AS EndTime FROM lineitem),
types AS (SELECT o_orderkey AS ID, CASE o_orderstatus WHEN 'F' THEN 'Anomaly' WHEN 'O' THEN 'Rare Event' ELSE 'Communication Gap' END AS Category,
  CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'Point' ELSE 'Subsequence' END AS Length, CASE WHEN o_orderpriority[1] IN ('1', '3') THEN 'Local' ELSE 'Global' END AS Locality FROM orders),
ev AS (SELECT ID AS event_id, min(StartTime) AS "start", max(EndTime) AS "end", list_sort(list(DISTINCT Channel)) AS ch, coalesce(max(Category), '') AS category, coalesce(max(Length), '') AS esa_length, coalesce(max(Locality), '') AS esa_locality FROM frag LEFT JOIN types USING (ID) GROUP BY 1)"""


@query(f"WITH {_ORDERS} SELECT event_id, \"start\", \"end\", array_to_string(ch, '|') AS channels, category, esa_length, esa_locality, category = 'Anomaly' AS is_anomaly, category = 'Rare Event' AS is_rare FROM ev")
def event_table(spark, d):
    e = E.event_table(*_orders(spark, d))
    return e.select("event_id", "start", "end", F.array_join("channels", "|").alias("channels"), "category", "esa_length", "esa_locality", "is_anomaly", "is_rare")


@query(f"""WITH {_ORDERS} SELECT event_id, CASE WHEN "end" < TIMESTAMP '{B.ORDERS_PATH_END}' AND "end" < TIMESTAMP '{B.ORDERS_CUT}' THEN 'path_train' WHEN "end" < TIMESTAMP '{B.ORDERS_CUT}' THEN 'pretest' WHEN "start" > TIMESTAMP '{B.ORDERS_CUT}' THEN 'test' ELSE 'boundary' END AS split,
  "end" < TIMESTAMP '{B.ORDERS_CUT}' AS in_train_pool, "start" > TIMESTAMP '{B.ORDERS_CUT}' AS in_test_pool FROM ev""")
def event_splits(spark, d):
    e = E.assign_splits(E.event_table(*_orders(spark, d)), B.ORDERS_PATH_END, B.ORDERS_CUT)
    return e.select("event_id", "split", "in_train_pool", "in_test_pool")


@query(f"WITH {_ORDERS} SELECT event_id, c AS channel, CASE c WHEN 'R' THEN 0 ELSE 1 END AS channel_idx FROM (SELECT event_id, unnest(ch) AS c FROM ev) WHERE c IN ('R', 'A')")
def event_channel_pairs(spark, d):
    dim = spark.createDataFrame([("R", 0), ("A", 1)], "channel string, channel_idx int")
    return E.channel_pairs(E.event_table(*_orders(spark, d)), dim).select("event_id", "channel", "channel_idx")


@query(f"WITH {_ORDERS} SELECT Channel, count(DISTINCT ID) AS n_events, count(DISTINCT ID) FILTER (Category = 'Anomaly') AS n_anomaly, count(DISTINCT ID) FILTER (Category = 'Rare Event') AS n_rare FROM frag LEFT JOIN types USING (ID) WHERE EndTime < TIMESTAMP '{B.ORDERS_CUT}' GROUP BY 1")
def label_counts(spark, d):
    return E.label_counts(*_orders(spark, d), B.ORDERS_CUT)


@query(f"WITH {B.PAIRS}, {B.OCCUPIED} SELECT channel_idx, CAST(bin AS INTEGER) AS bin FROM occ")
def occupancy_bins(spark, d):
    n = B.bounds(B.grid(spark, d))[1]
    return E.occupancy(B.pairs(spark, d), B.GUARD, n).select("channel_idx", F.col("bin").cast("int").alias("bin"))


@query(f"WITH {B.LABELED} SELECT event_id, channel, channel_idx, start, kind, placement, label_lo, label_hi, esa_length, esa_locality, round(list_sum(x), 6) AS total FROM labeled")
def s0_labeled_windows(spark, d):
    from orrery.functions import arrays as A

    return B.labeled(spark, d).select("event_id", "channel", "channel_idx", "start", "kind", "placement", "label_lo", "label_hi", "esa_length", "esa_locality", F.round(A.total(F.col("x")), 6).alias("total"))


@query(f"WITH {B.NOMINAL} SELECT channel, CAST(start AS BIGINT) AS start, round(list_sum(x), 6) AS total FROM nominal")
def nominal_sample(spark, d):
    from orrery.functions import arrays as A

    return B.nominal(spark, d).select("channel", "start", F.round(A.total(F.col("x")), 6).alias("total"))


@query(f"WITH {B.LABELED}, {B.OCCUPIED}, nominal AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY channel_idx ORDER BY {B.h(B.SEED, 'channel_idx', 'start')}, start) AS rk FROM finite f, size WHERE start + {W} <= n AND NOT EXISTS (SELECT 1 FROM occ WHERE occ.channel_idx = f.channel_idx AND occ.bin BETWEEN f.start AND f.start + {W - 1})) WHERE rk <= {B.PER_CHANNEL}) SELECT pool, channel, count(*) AS n FROM (SELECT 'nominal' AS pool, channel FROM nominal UNION ALL SELECT 'rare', channel FROM labeled, generate_series(1, 3) WHERE is_rare AND NOT is_anomaly) GROUP BY 1, 2")
def train_pool(spark, d):
    return windows.train_pool(B.nominal(spark, d), B.labeled(spark, d).withColumn("start", F.col("start").cast("bigint")), 3).groupBy("pool", "channel").agg(F.count("*").alias("n"))


@query(f"WITH {B.FOLDED} SELECT event_id, a AS is_anomaly, fold FROM fo")
def event_folds(spark, d):
    return folds.event_folds(B.labeled(spark, d), B.N_FOLDS, B.SEED)


_COUNTS = f"""cf AS (SELECT c.channel, k.fold, count(*) FILTER (f.is_anomaly) AS n_anomaly_windows, count(*) FILTER (f.is_rare) AS n_rare_windows FROM (SELECT DISTINCT channel FROM folded) c CROSS JOIN (SELECT unnest([0, 1, 2]) AS fold) k LEFT JOIN folded f ON f.channel = c.channel AND f.fold = k.fold GROUP BY 1, 2),
counts AS (SELECT *, n_anomaly_windows < {B.LEAST} AS below_min FROM cf)"""


@query(f"WITH {B.FOLDED}, {_COUNTS} SELECT * FROM counts")
def channel_fold_counts(spark, d):
    return folds.channel_fold_counts(B.folded(spark, d), B.LEAST, B.N_FOLDS)


@query(f"WITH {B.FOLDED}, {_COUNTS} SELECT event_id, channel, start, fold FROM folded f WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE c.channel = f.channel AND c.fold = f.fold AND below_min)")
def keep_fold_windows(spark, d):
    f = B.folded(spark, d)
    return folds.keep_fold(f, folds.channel_fold_counts(f, B.LEAST, B.N_FOLDS)).select("event_id", "channel", "start", "fold")


@query(f"WITH {B.KINDED} SELECT event_id, channel, start, kind_name FROM kinded")
def esa_kinds(spark, d):
    return B.kinded(spark, d).select("event_id", "channel", "start", "kind_name")


@query(f"WITH {B.LABELED} SELECT event_id, channel, start, CASE WHEN label_hi - label_lo < 8 AND {B.AMP} >= 150 THEN 'real short spike' WHEN label_hi - label_lo < 8 THEN 'real short subtle' WHEN {B.SHIFT} >= 5 THEN 'real level shift' WHEN label_hi - label_lo < 40 THEN 'real medium event' ELSE 'real long campaign' END AS kind_name FROM labeled")
def legacy_kinds(spark, d):
    k = kinds.shape_kind(F.col("x"), F.col("label_hi") - F.col("label_lo"), 150.0, 5.0, 8, 40)
    return B.labeled(spark, d).select("event_id", "channel", "start", k.alias("kind_name"))


_STAT = f"CASE WHEN kind_name LIKE '%level shift%' THEN {B.SHIFT} WHEN kind_name LIKE '%local subsequence%' THEN -{B.AMP} ELSE {B.AMP} END"


@query(f"WITH {B.KINDED} SELECT kind_name, event_id, channel, start, CAST(rk AS INTEGER) AS rank, round(s, 6) AS stat FROM (SELECT *, row_number() OVER (PARTITION BY kind_name ORDER BY s DESC, event_id, channel, start) AS rk FROM (SELECT *, {_STAT} AS s FROM kinded)) WHERE rk <= 10")
def rank_for_kind(spark, d):
    return kinds.rank_for_kind(B.kinded(spark, d), 10, ["event_id", "channel", "start"]).select("kind_name", "event_id", "channel", "start", "rank", F.round("stat", 6).alias("stat"))


@query(f"WITH {B.KINDED} SELECT kind_name, event_id, channel, start, leaked, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind_name ORDER BY event_id, channel, start) AS rk FROM (SELECT *, count(*) FILTER (fold <> 0) OVER (PARTITION BY kind_name) = 0 AS leaked FROM kinded) WHERE leaked OR fold <> 0) WHERE rk <= 20")
def kind_refs_oof(spark, d):
    return kinds.kind_refs(B.kinded(spark, d), 0, 20, ["event_id", "channel", "start"]).select("kind_name", "event_id", "channel", "start", "leaked", "rank")


@query(f"""WITH {B.KINDED}, m AS (SELECT kind_name, quantile_cont({B.AMP}, 0.5) AS mid FROM kinded GROUP BY 1),
o AS (SELECT k.*, round(abs({B.AMP} - mid), 9) AS off FROM kinded k JOIN m USING (kind_name)),
e AS (SELECT *, row_number() OVER (PARTITION BY kind_name, event_id ORDER BY off, channel, start) > 1 AS again FROM o)
SELECT kind_name, event_id, channel, start, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind_name ORDER BY again, off, event_id, channel, start) AS rk FROM e) WHERE rk <= 4""")
def kind_examples(spark, d):
    return kinds.kind_examples(B.kinded(spark, d), 4, ["event_id", "channel", "start"]).select("kind_name", "event_id", "channel", "start", "rank")


@query(f"WITH {B.DONOR} SELECT donor_id, channel_idx, {B.KINDS!r}[ntile({len(B.KINDS)}) OVER (ORDER BY donor_id)] AS kind_alloc FROM donors")
def kind_alloc_contiguous(spark, d):
    return kinds.alloc_contiguous(B.donors(spark, d), B.KINDS).select("donor_id", "channel_idx", "kind_alloc")


@query(f"WITH {B.DONOR}, t AS (SELECT *, ntile({len(B.KINDS)}) OVER (PARTITION BY channel_idx ORDER BY {B.h(B.SEED, 'donor_id')}, donor_id) AS tile, dense_rank() OVER (ORDER BY channel_idx) AS turn FROM donors) SELECT donor_id, channel_idx, {B.KINDS!r}[(tile - 1 + turn - 1) % {len(B.KINDS)} + 1] AS kind_alloc FROM t")
def kind_alloc_stratified(spark, d):
    return kinds.alloc_stratified(B.donors(spark, d), B.KINDS, B.SEED).select("donor_id", "channel_idx", "kind_alloc")


@query(f"WITH {B.FINITE}, {B.SCALER} SELECT channel_idx, round(lo, 6) AS lo, round(hi, 6) AS hi FROM scaler")
def channel_minmax(spark, d):
    return B.scaler(spark, d).select("channel_idx", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"WITH {B.EVERY}, {B.SCALER}, u AS (SELECT donor_id, list_transform(x, lambda v: -1 + (v - lo) / greatest(hi - lo, 1e-6) * 2) AS u FROM donors JOIN scaler USING (channel_idx)) SELECT donor_id, round(list_min(u), 6) AS low, round(list_max(u), 6) AS high, round(list_avg(u), 6) AS mean FROM u".replace("donor_id", "window_id"))
def minmax_transform(spark, d):
    from orrery.functions import arrays as A

    u = scaling.transform(B.every(spark, d), B.scaler(spark, d), (-1.0, 1.0))
    return u.select("window_id", F.round(F.array_min("x"), 6).alias("low"), F.round(F.array_max("x"), 6).alias("high"), F.round(A.mean(F.col("x")), 6).alias("mean"))
