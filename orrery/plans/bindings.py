"""How the test tables play the roles of the library's inputs, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import events as E
from orrery.operators import folds, inject, kinds, panel, scaling, windows

BIN, WIDTH, GUARD, MOST, SEED = 7200, 32, 2, 3, 7
CUT, PATH_END = "2024-01-25 00:00:00", "2024-01-18 00:00:00"
ORDERS_CUT, ORDERS_PATH_END = "2000-01-01 00:00:00", "1998-01-01 00:00:00"
N_FOLDS, LEAST, PER_CHANNEL, DONORS = 3, 5, 200, 256
KINDS = ["real ESA Point / Local", "real ESA Point / Global", "real ESA local subsequence", "real level shift", "real ESA global subsequence"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("channel"), "ts", "value", "event_id")


def grid(spark: SparkSession, d: str) -> DataFrame:
    return panel.mean_bins(raw(spark, d), BIN, CUT)


def bounds(p: DataFrame) -> tuple[str, int]:
    """First time and number of bins of a panel."""
    r = p.agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("t0"), (F.max("bin") + 1).alias("n")).first()
    return r["t0"] or CUT, int(r["n"] or 0)


def finite(spark: SparkSession, d: str) -> DataFrame:
    return panel.windows(grid(spark, d), WIDTH)


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Labelled spans on the panel: the highest samples of each channel; every third also on the next channel."""
    r = raw(spark, d)
    high = r.join(r.groupBy("channel").agg(F.percentile("value", F.lit(0.99)).alias("p")), "channel").where(F.col("value") >= F.col("p"))
    names = r.select("channel").distinct().agg(F.array_sort(F.collect_list("channel")).alias("names"))
    n = F.size("names")
    after = F.element_at("names", F.array_position("names", F.col("channel")).cast("int") % n + 1)
    both = F.when(F.col("event_id") % 3 == 0, F.array(F.col("channel"), after)).otherwise(F.array("channel"))
    end = F.col("ts") + F.make_dt_interval(hours=F.col("event_id").cast("int") % 96)
    return high.join(F.broadcast(names)).select(F.col("event_id").alias("ID"), F.explode(both).alias("Channel"), F.col("ts").alias("StartTime"), end.alias("EndTime"))


def types(labels: DataFrame) -> DataFrame:
    i = F.col("ID")
    return labels.select("ID").distinct().select(
        "ID",
        F.when(i % 2 == 0, "Anomaly").otherwise("Rare Event").alias("Category"),
        F.when(i % 4 < 2, "Point").otherwise("Subsequence").alias("Length"),
        F.when(i % 5 < 2, "Local").otherwise("Global").alias("Locality"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    labels = fragments(spark, d)
    p = grid(spark, d)
    t0, n = bounds(p)
    events = E.assign_splits(E.event_table(labels, types(labels)), PATH_END, CUT)
    return windows.label_bins(E.channel_pairs(events, panel.channels(raw(spark, d))), t0, BIN, n)


def labeled(spark: SparkSession, d: str) -> DataFrame:
    p = grid(spark, d)
    n = bounds(p)[1]
    return windows.labeled_windows(pairs(spark, d), panel.windows(p, WIDTH), WIDTH, MOST, n, n)


def nominal(spark: SparkSession, d: str) -> DataFrame:
    p = grid(spark, d)
    n = bounds(p)[1]
    occupied = E.occupancy(pairs(spark, d), GUARD, n)
    return windows.nominal_sample(panel.windows(p, WIDTH), occupied, WIDTH, PER_CHANNEL, n, SEED)


def folded(spark: SparkSession, d: str) -> DataFrame:
    w = labeled(spark, d)
    return w.join(folds.event_folds(w, N_FOLDS, SEED).select("event_id", "fold"), "event_id")


def kinded(spark: SparkSession, d: str) -> DataFrame:
    return folded(spark, d).withColumn("kind_name", kinds.esa_kind(F.col("x"), F.col("esa_length"), F.col("esa_locality"), 1.0))


def every(spark: SparkSession, d: str) -> DataFrame:
    """All finite windows, under one number for channel and start."""
    return finite(spark, d).select((F.col("channel_idx").cast("long") * 1_000_000_000 + F.col("start")).alias("window_id"), "channel_idx", "start", "x")


def donors(spark: SparkSession, d: str) -> DataFrame:
    """Donors of galleries: ``DONORS`` of each channel from all finite windows; a channel with fewer gives what it has."""
    f = finite(spark, d)
    from pyspark.sql import Window

    from orrery.functions import hashing

    order = Window.partitionBy("channel_idx").orderBy(hashing.hashed(SEED, F.col("channel_idx"), F.col("start")), "start")
    rows = f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DONORS)
    return rows.select((F.col("channel_idx") * DONORS + F.col("rank") - 1).cast("long").alias("donor_id"), "channel_idx", "start", "x")


def scaler(spark: SparkSession, d: str) -> DataFrame:
    return scaling.fit_minmax(finite(spark, d), panel.channels(raw(spark, d)))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All real windows and a gallery made from them, in units of the channel's range."""
    s = scaler(spark, d)
    real = every(spark, d).withColumnRenamed("window_id", "donor_id")
    made = inject.posthoc(real, WIDTH, SEED)
    return scaling.span_normalise(real.select("donor_id", "channel_idx", "x"), s), scaling.span_normalise(made, s)


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


# --- the same, as SQL ---

RAW = "raw AS (SELECT event_type AS channel, ts, value, event_id FROM events)"
GRID = f"""{RAW},
live AS (SELECT * FROM raw WHERE ts < TIMESTAMP '{CUT}' AND value IS NOT NULL AND NOT isnan(value)),
dim AS (SELECT channel, CAST(row_number() OVER (ORDER BY channel) - 1 AS INTEGER) AS channel_idx FROM (SELECT DISTINCT channel FROM live)),
b AS (SELECT channel, CAST(floor(epoch(ts) / {BIN}) AS BIGINT) AS g, avg(value) AS y, count(*) AS cnt FROM live GROUP BY 1, 2),
g0 AS (SELECT min(g) AS g0 FROM b),
panel AS (SELECT channel, channel_idx, t.g - g0 AS bin, make_timestamp(CAST(t.g * {BIN} * 1000000 AS BIGINT)) AS ts, y, coalesce(cnt, 0) AS cnt
  FROM dim CROSS JOIN g0 CROSS JOIN LATERAL (SELECT unnest(generate_series(g0, CAST(epoch(TIMESTAMP '{CUT}') AS BIGINT) // {BIN} - 1)) AS g) t LEFT JOIN b USING (channel, g)),
size AS (SELECT min(ts) AS t0, max(bin) + 1 AS n FROM panel)"""
FINITE = f"""{GRID},
finite AS (SELECT channel, channel_idx, bin AS start, x FROM (
  SELECT channel, channel_idx, bin, list(y) OVER w AS x, count(y) OVER w AS k FROM panel
  WINDOW w AS (PARTITION BY channel ORDER BY bin ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING)) WHERE k = {WIDTH})"""
FRAGMENTS = """names AS (SELECT channel AS c, lead(channel) OVER (ORDER BY channel) AS nxt, min(channel) OVER () AS first FROM (SELECT DISTINCT channel FROM raw)),
p99 AS (SELECT channel, quantile_cont(value, 0.99) AS p FROM raw GROUP BY 1),
high AS (SELECT raw.* FROM raw JOIN p99 USING (channel) WHERE value >= p),
frag AS (SELECT event_id AS ID, channel AS Channel, ts AS StartTime, ts + to_hours(CAST(event_id % 96 AS INTEGER)) AS EndTime FROM high
  UNION ALL SELECT event_id, coalesce(nxt, first), ts, ts + to_hours(CAST(event_id % 96 AS INTEGER)) FROM high JOIN names ON c = channel WHERE event_id % 3 = 0),
types AS (SELECT DISTINCT ID, CASE WHEN ID % 2 = 0 THEN 'Anomaly' ELSE 'Rare Event' END AS Category, CASE WHEN ID % 4 < 2 THEN 'Point' ELSE 'Subsequence' END AS Length, CASE WHEN ID % 5 < 2 THEN 'Local' ELSE 'Global' END AS Locality FROM frag)"""
PAIRS = f"""{FINITE}, {FRAGMENTS},
ev AS (SELECT ID AS event_id, min(StartTime) AS "start", max(EndTime) AS "end", list_sort(list(DISTINCT Channel)) AS channels, max(Category) AS category, max(Length) AS esa_length, max(Locality) AS esa_locality FROM frag LEFT JOIN types USING (ID) GROUP BY 1),
sp AS (SELECT *, category = 'Anomaly' AS is_anomaly, category = 'Rare Event' AS is_rare, "start" > TIMESTAMP '{CUT}' AS in_test_pool FROM ev),
pr0 AS (SELECT * EXCLUDE (channels), unnest(channels) AS channel FROM sp),
pr1 AS (SELECT pr0.*, channel_idx, n,
  CAST(greatest(0, least(n, ceil((epoch("start") - epoch(t0)) / {BIN}))) AS INTEGER) AS label_lo, CAST(greatest(0, least(n, floor((epoch("end") - epoch(t0)) / {BIN}) + 1)) AS INTEGER) AS hi0
  FROM pr0 JOIN dim USING (channel) CROSS JOIN size),
pairs AS (SELECT *, CASE WHEN hi0 <= label_lo THEN CAST(least(n, label_lo + 1) AS INTEGER) ELSE hi0 END AS label_hi FROM pr1)"""
LABELED = f"""{PAIRS},
pl AS (SELECT *, label_hi - label_lo >= {WIDTH} AS long, 1 + (label_hi - label_lo - {WIDTH}) // {WIDTH} AS crops FROM pairs WHERE NOT in_test_pool),
st AS (SELECT *, CASE WHEN long THEN 'crop' ELSE 'center' END AS placement, unnest(CASE
  WHEN NOT long THEN [CAST(greatest(0, least((label_lo + label_hi) // 2 - {WIDTH // 2}, n - {WIDTH})) AS INTEGER)]
  WHEN crops <= {MOST} THEN list_transform(generate_series(0, crops - 1), lambda i: CAST(label_lo + i * {WIDTH} AS INTEGER))
  ELSE list_transform(generate_series(0, {MOST - 1}), lambda i: CAST(round_even(label_lo + i * ((label_hi - label_lo - {WIDTH}) / {MOST - 1}.0), 0) AS INTEGER)) END) AS spot FROM pl),
labeled AS (SELECT st.* EXCLUDE ("start", "end"), spot AS start, x, CASE WHEN is_anomaly THEN 'anomaly' WHEN is_rare THEN 'rare' ELSE 'other' END AS kind
  FROM st JOIN finite f ON f.channel_idx = st.channel_idx AND f.start = st.spot WHERE spot >= 0 AND spot + {WIDTH} <= n)"""


def h(seed: int, *parts: str) -> str:
    """SQL of the keyed hash."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5('{seed}:' || {text}), 1, 8) AS BIGINT)"


OCCUPIED = f"""occ AS (SELECT DISTINCT channel_idx, unnest(generate_series(greatest(0, label_lo - {GUARD}), least(n, label_hi + {GUARD}) - 1)) AS bin FROM pairs WHERE NOT in_test_pool AND NOT is_rare)"""
NOMINAL = f"""{PAIRS}, {OCCUPIED},
nominal AS (SELECT channel, channel_idx, start, x FROM (SELECT f.*, row_number() OVER (PARTITION BY channel_idx ORDER BY {h(SEED, 'channel_idx', 'start')}, start) AS rk FROM finite f, size
  WHERE start + {WIDTH} <= n AND NOT EXISTS (SELECT 1 FROM occ WHERE occ.channel_idx = f.channel_idx AND occ.bin BETWEEN f.start AND f.start + {WIDTH - 1})) WHERE rk <= {PER_CHANNEL})"""
FOLDED = f"""{LABELED},
fe AS (SELECT event_id, bool_or(is_anomaly) AS a FROM labeled GROUP BY 1),
fs AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM fe),
fo AS (SELECT event_id, a, CAST(CASE WHEN na + nb < 2 THEN 0 ELSE (row_number() OVER (PARTITION BY CASE WHEN least(na, nb) >= {N_FOLDS} THEN CAST(a AS INTEGER) ELSE 0 END ORDER BY {h(SEED, 'event_id')}, event_id) - 1) % {N_FOLDS} END AS INTEGER) AS fold FROM fe, fs),
folded AS (SELECT labeled.*, fold FROM labeled JOIN fo USING (event_id))"""
SHIFT = f"abs(list_avg(x[1:{WIDTH // 2}]) - list_avg(x[{WIDTH // 2 + 1}:]))"
AMP = "(list_max(x) - list_min(x))"
KINDED = f"""{FOLDED},
kinded AS (SELECT *, CASE WHEN esa_length = 'Point' THEN CASE WHEN esa_locality = 'Local' THEN '{KINDS[0]}' ELSE '{KINDS[1]}' END
  WHEN esa_locality = 'Local' THEN '{KINDS[2]}' WHEN {SHIFT} >= 1.0 THEN '{KINDS[3]}' ELSE '{KINDS[4]}' END AS kind_name FROM folded)"""
DONOR = f"""{FINITE},
donors AS (SELECT CAST(channel_idx * {DONORS} + rk - 1 AS BIGINT) AS donor_id, channel_idx, start, x FROM (SELECT *, row_number() OVER (PARTITION BY channel_idx ORDER BY {h(SEED, 'channel_idx', 'start')}, start) AS rk FROM finite) WHERE rk <= {DONORS})"""
EVERY = f"""{FINITE},
donors AS (SELECT CAST(channel_idx AS BIGINT) * 1000000000 + start AS donor_id, channel_idx, start, x FROM finite)"""
SCALER = """scaler AS (SELECT dim.channel_idx, coalesce(min(list_min(x)), 0.0) AS lo, coalesce(max(list_max(x)), 1.0) AS hi FROM dim LEFT JOIN finite USING (channel_idx) GROUP BY 1)"""
