"""Queries of features, scores, fidelity, detection, generators, energies and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import hashing, spectral
from orrery.operators import detection, editor, energy, fidelity, inject, kinds, models, scaling, scoring, selection
from orrery.plans import bindings as B
from orrery.plans.registry import query

W = B.WIDTH


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


# Per-value table of donors, in SQL: (donor_id, channel_idx, t from 0, v).
LONG = f"{B.DONOR}, long AS (SELECT donor_id, channel_idx, unnest(x) AS v, unnest(generate_series(0, {W - 1})) AS t FROM donors)"
# The same of all windows; queries of single windows name them window_id.
ALL = f"{B.EVERY}, long AS (SELECT donor_id, channel_idx, unnest(x) AS v, unnest(generate_series(0, {W - 1})) AS t FROM donors)"
STATS = "s AS (SELECT donor_id, avg(v) AS m, stddev_pop(v) AS d FROM long GROUP BY 1)"
DFT = f"""k AS (SELECT unnest(generate_series(0, {W // 2})) AS k),
dft AS (SELECT donor_id, channel_idx, k, sum(z * cos(2 * pi() * k * t / {W})) AS re, sum(z * sin(2 * pi() * k * t / {W})) AS im FROM zs CROSS JOIN k GROUP BY 1, 2, 3)"""


def whole(sql: str):
    """A query of every finite window."""
    return query(sql.replace("donor_id", "window_id"))


@whole(f"""WITH {ALL}, {STATS}, zs AS (SELECT long.*, (v - m) / CASE WHEN d < 1e-8 THEN 1 ELSE d END AS z FROM long JOIN s USING (donor_id)), {DFT},
df AS (SELECT donor_id, t, z - lag(z) OVER (PARTITION BY donor_id ORDER BY t) AS dz FROM zs),
d2 AS (SELECT donor_id, avg(dz) AS dz_mean, stddev_pop(dz) AS dz_std FROM df GROUP BY 1),
runs AS (SELECT donor_id, max(n) AS n FROM (SELECT donor_id, g, count(*) AS n FROM (SELECT donor_id, t, abs(z) > 1 AS hi, t - row_number() OVER (PARTITION BY donor_id, abs(z) > 1 ORDER BY t) AS g FROM zs) WHERE hi GROUP BY 1, 2) GROUP BY 1),
bands AS (SELECT donor_id, CASE WHEN k < {(W // 2 + 1) // 4} THEN 0 WHEN k < {(W // 2 + 1) * 2 // 4} THEN 1 WHEN k < {(W // 2 + 1) * 3 // 4} THEN 2 ELSE 3 END AS b, ln(avg(re * re + im * im) + 1e-8) AS e FROM dft GROUP BY 1, 2)
SELECT donor_id, round(avg(z), 6) + 0.0 AS z_mean, round(stddev_pop(z), 6) AS z_std, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(max(dz_mean), 6) + 0.0 AS dz_mean, round(max(dz_std), 6) AS dz_std, round(max(abs(z)), 6) AS peak, round(coalesce(max(n), 0) / {W}.0, 6) AS excursion,
  round((SELECT e FROM bands WHERE bands.donor_id = zs.donor_id AND b = 0), 5) AS band0, round((SELECT e FROM bands WHERE bands.donor_id = zs.donor_id AND b = 1), 5) AS band1, round((SELECT e FROM bands WHERE bands.donor_id = zs.donor_id AND b = 2), 5) AS band2, round((SELECT e FROM bands WHERE bands.donor_id = zs.donor_id AND b = 3), 5) AS band3
FROM zs LEFT JOIN d2 USING (donor_id) LEFT JOIN runs USING (donor_id) GROUP BY donor_id""")
def feature_pack(spark, d):
    """The twelve-feature pack: z-scores, their steps, peak, excursion and four log-bands."""
    rows = B.every(spark, d).withColumns({"z": A.zscores(F.col("x")), "b": spectral.log_bands("x")}).withColumn("dz", A.steps(F.col("z")))
    z, dz = F.col("z"), F.col("dz")
    out = rows.select(
        "window_id", A.mean(z).alias("z_mean"), A.std(z).alias("z_std"), F.array_min(z).alias("z_min"), F.array_max(z).alias("z_max"), A.mean(dz).alias("dz_mean"), A.std(dz).alias("dz_std"),
        F.array_max(F.transform(z, F.abs)).alias("peak"), (A.longest_run(F.transform(z, lambda v: F.abs(v) > 1)) / F.size(z)).alias("excursion"), *[F.round(F.col("b")[i], 5).alias(f"band{i}") for i in range(4)],
    )
    return out.select("window_id", (F.round("z_mean", 6) + F.lit(0.0)).alias("z_mean"), *r6("z_std", "z_min", "z_max"), (F.round("dz_mean", 6) + F.lit(0.0)).alias("dz_mean"), *r6("dz_std", "peak", "excursion"), "band0", "band1", "band2", "band3")


@whole(f"""WITH {ALL}, {STATS}, c AS (SELECT donor_id, t, v - m AS c, d FROM long JOIN s USING (donor_id)), l AS (SELECT *, lead(c) OVER (PARTITION BY donor_id ORDER BY t) AS nx FROM c)
SELECT l.donor_id, round(any_value(m), 6) AS mean, round(any_value(s.d), 6) AS std, round(regr_slope(c, t) * {W - 1}, 6) AS trend, round(avg(pow(c / s.d, 3)), 6) AS skew, round(avg(pow(c / s.d, 4)) - 3, 6) AS kurtosis, round(sum(c * nx) / sum(c * c), 6) AS acf1 FROM l JOIN s USING (donor_id) GROUP BY 1""")
def interpretable_features(spark, d):
    rows = B.every(spark, d).select("window_id", A.moments(F.col("x")).alias("m")).select("window_id", "m.*")
    return rows.select("window_id", *r6(*fidelity.FEATURES))


@whole(f"WITH {ALL}, s AS (SELECT donor_id, abs(v - lag(v) OVER (PARTITION BY donor_id ORDER BY t)) AS a FROM long) SELECT donor_id, round(sum(a) / {W - 1}, 6) AS tv FROM s GROUP BY 1")
def total_variation(spark, d):
    return B.every(spark, d).select("window_id", F.round(A.total_variation(F.col("x")), 6).alias("tv"))


@whole(f"""WITH {ALL}, c AS (SELECT donor_id, t + 1 AS k, sum(v) OVER (PARTITION BY donor_id ORDER BY t) AS cs, sum(v) OVER (PARTITION BY donor_id) AS total FROM long),
e AS (SELECT donor_id, k, sqrt(k * ({W} - k) / {W}.0) * (cs / k - (total - cs) / ({W} - k)) AS c FROM c WHERE k < {W})
SELECT donor_id, round(arg_max(c, round(abs(c), 9) * 1000000 - k / 1e6), 5) AS contrast, round(arg_max(k, round(abs(c), 9) * 1000000 - k / 1e6) / {W}.0, 6) AS split FROM e GROUP BY 1""")
def cusum(spark, d):
    return B.every(spark, d).select("window_id", A.cusum(F.col("x")).alias("c")).select("window_id", F.round("c.contrast", 5).alias("contrast"), F.round("c.split", 6).alias("split"))


@whole(f"WITH {B.EVERY} SELECT donor_id, round(list_avg(x[{W - W // 4 + 1}:]) - list_avg(x[1:{W // 4}]), 6) AS persistence FROM donors")
def persistence(spark, d):
    return B.every(spark, d).select("window_id", F.round(A.persistence(F.col("x")), 6).alias("persistence"))


_RESIDUAL = f"""pad AS (SELECT donor_id, t + 4 AS p, v FROM long UNION ALL SELECT donor_id, p, v FROM long, (SELECT unnest([0, 1, 2, 3]) AS p) WHERE t = 0 UNION ALL SELECT donor_id, {W} + p, v FROM long, (SELECT unnest([4, 5, 6, 7]) AS p) WHERE t = {W - 1}),
res AS (SELECT l.donor_id, l.t, any_value(l.v) - quantile_cont(p.v, 0.5) AS r FROM long l JOIN pad p ON p.donor_id = l.donor_id AND p.p BETWEEN l.t AND l.t + 8 GROUP BY 1, 2)"""


@whole(f"""WITH {ALL}, {_RESIDUAL}, m AS (SELECT donor_id, quantile_cont(r, 0.5) AS med FROM res GROUP BY 1), n AS (SELECT donor_id, quantile_cont(abs(r - med), 0.5) AS mad FROM res JOIN m USING (donor_id) GROUP BY 1),
f AS (SELECT donor_id, t, abs(r - med) > greatest(4 * mad, 1e-12) AS f FROM res JOIN m USING (donor_id) JOIN n USING (donor_id)), g AS (SELECT donor_id, f AND NOT coalesce(lag(f) OVER (PARTITION BY donor_id ORDER BY t), false) AS s FROM f)
SELECT donor_id, CAST(count(*) FILTER (s) AS INTEGER) AS excursions FROM g GROUP BY 1""")
def excursion_count(spark, d):
    return B.every(spark, d).select("window_id", A.excursions(F.col("x")).alias("excursions"))


@whole(f"WITH {ALL}, {_RESIDUAL} SELECT donor_id, round(arg_max(r, (round(abs(r), 9), -t)), 6) AS severity, round(arg_max(t, (round(abs(r), 9), -t)) / {W - 1}.0, 6) AS position FROM res GROUP BY 1")
def signed_peak(spark, d):
    return B.every(spark, d).select("window_id", A.signed_peak(F.col("x")).alias("p")).select("window_id", F.round("p.severity", 6).alias("severity"), F.round("p.position", 6).alias("position"))


@whole(f"WITH {ALL}, s AS (SELECT donor_id, v - lag(v) OVER (PARTITION BY donor_id ORDER BY t) AS a FROM long) SELECT donor_id, round(stddev_pop(a), 8) AS std, round(quantile_cont(abs(a), 0.99), 8) AS p99, round(quantile_cont(abs(a), 0.999), 8) AS p999 FROM s GROUP BY 1")
def first_difference(spark, d):
    s = B.every(spark, d).withColumn("s", A.steps(F.col("x"))).withColumn("a", F.transform("s", F.abs))
    return s.select("window_id", F.round(A.std(F.col("s")), 8).alias("std"), F.round(A.quantile(F.col("a"), 0.99), 8).alias("p99"), F.round(A.quantile(F.col("a"), 0.999), 8).alias("p999"))


@whole(f"WITH {ALL} SELECT donor_id, CAST(coalesce(max(n), 0) AS INTEGER) AS run FROM (SELECT donor_id, hi, count(*) FILTER (hi) AS n FROM (SELECT donor_id, v > 40 AS hi, t - row_number() OVER (PARTITION BY donor_id, v > 40 ORDER BY t) AS g FROM long) GROUP BY donor_id, hi, g) GROUP BY 1")
def longest_run(spark, d):
    return B.every(spark, d).select("window_id", A.longest_run(F.transform(F.col("x"), lambda v: v > 40)).alias("run"))


_NARROW = "nar AS (SELECT channel_idx, lo + 0.1 * (hi - lo) AS lo, hi - 0.3 * (hi - lo) AS hi FROM scaler)"


@whole(f"WITH {ALL}, {B.SCALER}, {_NARROW}, u AS (SELECT donor_id, (v - lo) / greatest(hi - lo, 1e-12) AS u FROM long JOIN nar USING (channel_idx)) SELECT donor_id, round(avg(CAST(u < 0 OR u > 1 AS INTEGER)), 6) AS outside_frac, bool_or(u < 0 OR u > 1) AS any_outside, round(max(greatest(-u, u - 1, 0)), 6) AS excess FROM u GROUP BY 1")
def envelope(spark, d):
    span = F.col("hi") - F.col("lo")
    narrow = B.scaler(spark, d).select("channel_idx", (F.col("lo") + 0.1 * span).alias("lo"), (F.col("hi") - 0.3 * span).alias("hi"))
    return scaling.envelope(B.every(spark, d), narrow).select("window_id", F.round("outside_frac", 6).alias("outside_frac"), "any_outside", F.round("excess", 6).alias("excess"))


@whole(f"""WITH {ALL}, m AS (SELECT channel_idx, avg(v) AS m FROM long GROUP BY 1), z AS (SELECT donor_id, channel_idx, t, v - m AS z FROM long JOIN m USING (channel_idx)), va AS (SELECT channel_idx, avg(z * z) AS va FROM z GROUP BY 1)
SELECT a.channel_idx, CAST(b.t - a.t AS INTEGER) AS lag, round(avg(a.z * b.z) / any_value(va), 6) AS acf FROM z a JOIN z b ON a.donor_id = b.donor_id AND b.t - a.t BETWEEN 0 AND 15 JOIN va ON va.channel_idx = a.channel_idx GROUP BY 1, 2""")
def pooled_acf(spark, d):
    return fidelity.pooled_acf(B.every(spark, d), 16, ["channel_idx"]).select("channel_idx", "lag", F.round("acf", 6).alias("acf"))


@whole(f"WITH {ALL}, {STATS}, zs AS (SELECT long.*, v - m AS z FROM long JOIN s USING (donor_id)), {DFT} SELECT channel_idx, CAST(k AS INTEGER) AS bin, round(avg((re * re + im * im) / {W}), 4) AS psd FROM dft WHERE k > 0 GROUP BY 1, 2")
def mean_psd(spark, d):
    c = B.every(spark, d).select("channel_idx", A.let(A.mean(F.col("x")), lambda m: F.transform(F.col("x"), lambda v: v - m)).alias("x"))
    p = c.select("channel_idx", F.posexplode(spectral.power("x")).alias("bin", "p")).where("bin > 0")
    return p.groupBy("channel_idx", "bin").agg(F.round(F.avg("p") / W, 4).alias("psd"))


@whole(f"WITH {ALL}, {STATS}, zs AS (SELECT long.*, v - m AS z FROM long JOIN s USING (donor_id)), {DFT}, a AS (SELECT donor_id, k, round(2 * sqrt(re * re + im * im) / {W}, 9) AS a FROM dft WHERE k > 0) SELECT donor_id, CAST(arg_max(k, (a, -k)) AS INTEGER) AS bin, round(max(a), 5) AS amplitude FROM a GROUP BY 1")
def dominant_fft(spark, d):
    return B.every(spark, d).select("window_id", spectral.dominant("x").alias("f")).select("window_id", "f.bin", F.round("f.amplitude", 5).alias("amplitude"))


# --- generators and editors ---


def _hash_u(name: str, col: str = "donor_id", seed: int = B.SEED) -> str:
    return f"((CAST('0x' || substr(md5('{seed}:{name}:' || CAST({col} AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _hash_i(name: str, lo: str, hi: str, seed: int = B.SEED) -> str:
    return f"({lo} + CAST('0x' || substr(md5('{seed}:{name}:' || CAST(donor_id AS VARCHAR)), 1, 8) AS BIGINT) % greatest({hi} - ({lo}), 1))"


POSTHOC = f"""ph AS (SELECT *, ['step', 'pulse', 'ramp', 'scale'][{_hash_i('family', '1', '5')}] AS family, CASE WHEN {_hash_u('sign')} < 0.5 THEN 1 ELSE -1 END AS sign, 0.5 + 1.5 * {_hash_u('amp')} AS amp, 0.5 + 1.5 * {_hash_u('more')} AS more,
  {_hash_i('step0', str(W // 8), str(7 * W // 8))} AS step0, {_hash_i('pulse0', '0', str(W - 8))} AS pulse0, {_hash_i('dur', '4', str(max(5, W // 8)))} AS dur, {_hash_i('ramp0', '0', str(W // 2))} AS ramp0 FROM donors),
ph1 AS (SELECT ph.*, {_hash_i('ramp1', 'ramp0 + 4', str(W + 1))} AS ramp1, CASE WHEN d < 1e-8 THEN 1 ELSE d END AS sd FROM ph JOIN s USING (donor_id)),
made AS (SELECT ph1.donor_id, ph1.channel_idx, family, t, CASE WHEN family = 'step' AND t >= step0 OR family = 'pulse' AND t >= pulse0 AND t < pulse0 + dur THEN v + sign * amp * sd
  WHEN family = 'ramp' AND t >= ramp0 AND t < ramp1 THEN v + sign * amp * sd * (t - ramp0) / (ramp1 - ramp0 - 1) WHEN family = 'scale' THEN v * (1 + sign * more * 0.25) ELSE v END AS y FROM ph1 JOIN long USING (donor_id))"""


@query(f"WITH {LONG}, {STATS}, {POSTHOC} SELECT donor_id, any_value(family) AS family, round(sum(y), 5) AS total, round(sum(y * t), 4) AS moment FROM made GROUP BY 1")
def gallery_posthoc(spark, d):
    g = inject.posthoc(B.donors(spark, d), W, B.SEED)
    return g.select("donor_id", "family", F.round(A.total(F.col("x")), 5).alias("total"), F.round(A.total(F.transform(F.col("x"), lambda v, t: v * t)), 4).alias("moment"))


_RING = f"""ring AS (SELECT donor_id, channel_idx, row_number() OVER (PARTITION BY channel_idx ORDER BY CAST('0x' || substr(md5('{{seed}}:partner:' || donor_id), 1, 8) AS BIGINT), donor_id) - 1 AS spot, count(*) OVER (PARTITION BY channel_idx) AS n FROM donors),
other AS (SELECT a.donor_id, b.donor_id AS o FROM ring a JOIN ring b ON b.channel_idx = a.channel_idx AND b.spot = (a.spot + CASE WHEN a.n > 1 THEN 1 + CAST('0x' || substr(md5('{{seed}}:partner hop:' || a.donor_id), 1, 8) AS BIGINT) % (a.n - 1) ELSE 0 END) % a.n)"""
_CS = B.SEED * 1000


@query(f"""WITH {LONG}, {STATS}, {_RING.replace('{seed}', str(_CS))},
l AS (SELECT donor_id, least({W}, {_hash_i('len', str(max(4, round(0.08 * W))), str(max(5, round(0.35 * W) + 1)), _CS)}) AS len FROM donors),
c AS (SELECT l.donor_id, len, {_hash_i('cut', '0', f'{W} - len + 1', _CS).replace('donor_id', 'l.donor_id')} AS c0, {_hash_i('paste', '0', f'{W} - len + 1', _CS).replace('donor_id', 'l.donor_id')} AS p0, (2 * {_hash_u('slope', 'l.donor_id', _CS)} - 1) * 0.5 * CASE WHEN d < 1e-8 THEN 1 ELSE d END AS slope, o FROM l JOIN s ON s.donor_id = l.donor_id JOIN other ON other.donor_id = l.donor_id),
y AS (SELECT a.donor_id, a.t, CASE WHEN a.t >= p0 AND a.t < p0 + len THEN b.v + slope * (a.t - p0) / (len - 1) ELSE a.v END AS y FROM long a JOIN c USING (donor_id) LEFT JOIN long b ON b.donor_id = o AND b.t = c0 + a.t - p0)
SELECT donor_id, round(sum(y), 5) AS total, round(sum(y * t), 4) AS moment FROM y GROUP BY 1""")
def gallery_cutaddpaste(spark, d):
    """Without jitter, which SQL could state only at length; with it the gallery is tested by its properties."""
    g = inject.cutaddpaste(B.donors(spark, d), W, B.SEED, jitter=0.0)
    return g.select("donor_id", F.round(A.total(F.col("x")), 5).alias("total"), F.round(A.total(F.transform(F.col("x"), lambda v, t: v * t)), 4).alias("moment"))


_QUARTER = W // 16 if W // 16 > 4 else 4
TAXONOMY = f"""{_RING.replace('{seed}', str(B.SEED))},
tx0 AS (SELECT donors.donor_id, ['point', 'contextual', 'shapelet', 'seasonal', 'trend'][{_hash_i('family', '1', '6')}] AS family, CASE WHEN {_hash_u('sign')} < 0.5 THEN 1 ELSE -1 END AS sign, 0.5 + 1.5 * {_hash_u('sev')} AS sev,
  {_hash_i('points', '1', '4')} AS n_pts, {_hash_i('point', '0', str(W))} AS pt, {_hash_i('hop', '1', str(max(2, W // 3)))} AS hop, 2 + 3 * {_hash_u('boost')} AS boost, {_hash_i('context', str(_QUARTER), str(W - _QUARTER))} AS ct, 3 + 3 * {_hash_u('cboost')} AS cboost,
  least({W}, {_hash_i('len', str(min(max(8, W // 16), W)), str(max(min(max(8, W // 16), W) + 1, W // 4)))}) AS len, {_hash_i('t0', '0', str(W - max(8, W // 8) + 1))} AS t0, {_hash_i('w0', '0', str(W - max(16, W // 8) + 1))} AS w0, 12 + {max(13.0, W / 4) - 12} * {_hash_u('period')} AS period FROM donors),
tx AS (SELECT tx0.*, o, CASE WHEN d < 1e-8 THEN 1 ELSE d END AS sd, {_hash_i('cut', '0', f'{W} - len + 1')} AS c0, {_hash_i('paste', '0', f'{W} - len + 1')} AS p0, {_hash_i('t1', f't0 + {max(8, W // 8)}', str(W + 1))} AS t1, {_hash_i('w1', f'w0 + {max(16, W // 8)}', str(W + 1))} AS w1
  FROM tx0 JOIN s USING (donor_id) JOIN other USING (donor_id)),
nb AS (SELECT donor_id, avg(v) AS mu, greatest(stddev_pop(v), 0.25 * any_value(sd), 1e-8) AS near FROM long JOIN tx USING (donor_id) WHERE t BETWEEN ct - {_QUARTER} AND ct + {_QUARTER} AND t <> ct GROUP BY 1),
mine AS (SELECT donor_id, avg(v) AS m FROM long JOIN tx USING (donor_id) WHERE t >= p0 AND t < p0 + len GROUP BY 1), theirs AS (SELECT tx.donor_id, avg(v) AS m FROM tx JOIN long l ON l.donor_id = o AND l.t >= c0 AND l.t < c0 + len GROUP BY 1),
made AS (SELECT l.donor_id, l.channel_idx, family, l.t, CASE
  WHEN family = 'point' AND list_contains(list_transform(generate_series(0, n_pts - 1), lambda j: (pt + j * hop) % {W}), l.t) THEN l.v + sign * sev * sd * boost
  WHEN family = 'contextual' AND l.t = ct THEN mu + sign * sev * near * cboost WHEN family = 'shapelet' AND l.t >= p0 AND l.t < p0 + len THEN b.v + mine.m - theirs.m
  WHEN family = 'seasonal' AND l.t >= w0 AND l.t < w1 THEN l.v + sign * sev * sd * sin(2 * pi() * (l.t - w0) / period) WHEN family = 'trend' AND l.t >= t0 AND l.t < t1 THEN l.v + sign * sev * sd * (l.t - t0) / (t1 - t0 - 1) ELSE l.v END AS y
  FROM long l JOIN tx ON tx.donor_id = l.donor_id JOIN nb ON nb.donor_id = l.donor_id JOIN mine ON mine.donor_id = l.donor_id JOIN theirs ON theirs.donor_id = l.donor_id LEFT JOIN long b ON b.donor_id = o AND b.t = c0 + len - 1 - (l.t - p0))"""


@query(f"WITH {LONG}, {STATS}, {TAXONOMY} SELECT donor_id, channel_idx, any_value(family) AS family, round(sum(y), 5) AS total FROM made GROUP BY 1, 2")
def gallery_taxonomy(spark, d):
    g = inject.taxonomy(B.donors(spark, d), W, B.SEED)
    return g.select("donor_id", "channel_idx", "family", F.round(A.total(F.col("x")), 5).alias("total"))


@query(f"WITH {LONG}, {STATS}, {POSTHOC}, a AS (SELECT donor_id, max(v) - min(v) AS r FROM long GROUP BY 1), e AS (SELECT donor_id, t, v, CASE WHEN pow(v - y, 2) > 5.0 * greatest(r, 1e-12) THEN y ELSE v END AS e FROM long JOIN made USING (donor_id, t) JOIN a USING (donor_id)) SELECT donor_id, round(sum(e), 5) AS total, round(avg(CAST(e <> v AS INTEGER)), 6) AS changed_frac, bool_or(e <> v) AS changed FROM e GROUP BY 1")
def deviation_patch(spark, d):
    base = B.donors(spark, d)
    both = base.select("donor_id", F.col("x").alias("parent")).join(inject.posthoc(base, W, B.SEED).select("donor_id", F.col("x").alias("generated")), "donor_id")
    p = both.withColumn("e", editor.deviation_patch(F.col("parent"), F.col("generated"), 5.0))
    return p.select("donor_id", F.round(A.total(F.col("e")), 5).alias("total"), editor.patch_share(F.col("parent"), F.col("e")).alias("s")).select("donor_id", "total", F.round("s.changed_frac", 6).alias("changed_frac"), "s.changed")


@query(f"WITH {LONG}, {STATS}, {POSTHOC} SELECT round(sqrt(avg(mse)), 6) AS rmse, round(quantile_cont(sqrt(mse), 0.5), 6) AS median_rmse, round(avg(c), 6) AS shape_corr FROM (SELECT donor_id, avg(pow(v - y, 2)) AS mse, corr(v, y) AS c FROM long JOIN made USING (donor_id, t) GROUP BY 1)")
def reconstruction_scores(spark, d):
    base = B.donors(spark, d)
    both = base.select("donor_id", F.col("x").alias("parent")).join(inject.posthoc(base, W, B.SEED).select("donor_id", F.col("x").alias("generated")), "donor_id")
    return editor.reconstruction(both).select(*r6("rmse", "median_rmse", "shape_corr"))


@query(f"""WITH {LONG}, {STATS}, {POSTHOC}, g AS (SELECT a.donor_id, a.t, a.v, y, y - v AS df FROM long a JOIN made m ON m.donor_id = a.donor_id AND m.t = a.t),
k AS (SELECT unnest([0, 1, 2]) AS k), f AS (SELECT donor_id, k, sum(df * cos(2 * pi() * k * t / {W})) AS re, sum(df * sin(2 * pi() * k * t / {W})) AS im FROM g CROSS JOIN k GROUP BY 1, 2),
e AS (SELECT g.donor_id, g.t, any_value(v) + sum(CASE WHEN k = 0 THEN re / {W} ELSE 2.0 / {W} * (re * cos(2 * pi() * k * t / {W}) + im * sin(2 * pi() * k * t / {W})) END) AS e FROM g JOIN f USING (donor_id) GROUP BY 1, 2)
SELECT donor_id, round(sum(e), 5) AS total, round(sum(e * t), 4) AS moment FROM e GROUP BY 1""")
def residual_copy(spark, d):
    base = B.donors(spark, d)
    both = base.select("donor_id", F.col("x").alias("parent")).join(inject.posthoc(base, W, B.SEED).select("donor_id", F.col("x").alias("generated")), "donor_id")
    e = editor.residual_copy(both, 3)
    return e.select("donor_id", F.round(A.total(F.col("edited")), 5).alias("total"), F.round(A.total(F.transform("edited", lambda v, t: v * t)), 4).alias("moment"))


_EXAMPLES = f"""{B.KINDED}, mid AS (SELECT kind_name, quantile_cont({B.AMP}, 0.5) AS mid FROM kinded GROUP BY 1),
o AS (SELECT kinded.*, round(abs({B.AMP} - mid), 9) AS off FROM kinded JOIN mid USING (kind_name)),
ag AS (SELECT *, least(row_number() OVER (PARTITION BY kind_name, event_id ORDER BY off, channel, start), 2) AS again FROM o),
ex AS (SELECT kind_name, {B.h(B.SEED, 'event_id', 'channel', 'start')} AS query_id, x FROM (SELECT *, row_number() OVER (PARTITION BY kind_name ORDER BY again, off, event_id, channel, start) AS k FROM ag) WHERE k <= 4),
donors AS (SELECT CAST(channel_idx * {B.DONORS} + rk - 1 AS BIGINT) AS donor_id, channel_idx, start, x FROM (SELECT *, row_number() OVER (PARTITION BY channel_idx ORDER BY {B.h(B.SEED, 'channel_idx', 'start')}, start) AS rk FROM finite) WHERE rk <= {B.DONORS}),
al AS (SELECT donor_id, x, {B.KINDS!r}[(ntile({len(B.KINDS)}) OVER (PARTITION BY channel_idx ORDER BY {B.h(B.SEED, 'donor_id')}, donor_id) - 1 + dense_rank() OVER (ORDER BY channel_idx) - 1) % {len(B.KINDS)} + 1] AS kind_name FROM donors),
cand AS MATERIALIZED (SELECT e.kind_name, query_id, donor_id, dense_rank() OVER (PARTITION BY e.kind_name ORDER BY query_id) AS turn, sqrt(list_sum(list_transform(list_zip(e.x, al.x), lambda p: pow(p[1] - p[2], 2)))) AS distance FROM ex e JOIN al USING (kind_name))"""
_TURN = "t{k} AS MATERIALIZED (SELECT kind_name, any_value(query_id) AS query_id, arg_min(donor_id, (distance, donor_id)) AS donor_id, min(distance) AS distance FROM cand c WHERE turn = {k} AND NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.kind_name = c.kind_name AND b.donor_id = c.donor_id) GROUP BY 1)"
_TURNS = ", ".join(_TURN.format(k=k, before=" UNION ALL ".join(f"SELECT kind_name, donor_id FROM t{i}" for i in range(1, k)) or "SELECT '' AS kind_name, -1 AS donor_id") for k in range(1, 5))


@query(f"WITH {_EXAMPLES}, {_TURNS} SELECT kind_name, query_id, donor_id, round(distance, 6) AS distance FROM ({' UNION ALL '.join(f'SELECT * FROM t{k}' for k in range(1, 5))})")
def nearest_generated(spark, d):
    """A query's number is a keyed hash of its window, so SQL can take them in the same order."""
    number = hashing.hashed(B.SEED, F.col("event_id"), F.col("channel"), F.col("start"))
    q = kinds.kind_examples(B.kinded(spark, d), 4, ["event_id", "channel", "start"]).select("kind_name", number.alias("query_id"), "x")
    g = kinds.alloc_stratified(B.donors(spark, d), B.KINDS, B.SEED).select(F.col("kind_alloc").alias("kind_name"), "donor_id", "x")
    return kinds.nearest_generated(q, g).withColumn("distance", F.round("distance", 6))


# One step a point: m is each row's squared distance to the nearest point chosen so far.
_STEP = """m{k} AS MATERIALIZED (SELECT d.donor_id, d.x, least(m, list_sum(list_transform(list_zip(d.x, c.x), lambda p: pow(p[1] - p[2], 2)))) AS m FROM m{before} d, c{before} c),
c{k} AS MATERIALIZED (SELECT donor_id, x FROM m{k} WHERE m > 0 ORDER BY m DESC, donor_id LIMIT 1)"""


@query(f"WITH {B.DONOR}, m0 AS (SELECT donor_id, x, CAST('infinity' AS DOUBLE) AS m FROM donors), c0 AS MATERIALIZED (SELECT donor_id, x FROM m0 ORDER BY donor_id LIMIT 1), {', '.join(_STEP.format(k=k, before=k - 1) for k in range(1, 16))} {' UNION ALL '.join(f'SELECT donor_id, CAST({k} AS INTEGER) AS rank FROM c{k}' for k in range(16))}")
def farthest_points(spark, d):
    return kinds.farthest_points(B.donors(spark, d), 16)


# --- scoring on embeddings ---

EMB = """q AS (SELECT vec_id AS query_id, embedding AS x, CASE WHEN label <= 2 THEN 'anomaly' ELSE 'rare' END AS side FROM embeddings WHERE label <= 5),
g AS (SELECT vec_id, embedding AS x, CASE WHEN label <= 7 THEN 'm67' ELSE 'm89' END AS method FROM embeddings WHERE label >= 6),
dist AS (SELECT query_id, side, method, sqrt(min(list_sum(list_transform(list_zip(CAST(q.x AS DOUBLE[]), CAST(g.x AS DOUBLE[])), lambda p: pow(p[1] - p[2], 2))))) AS d FROM q CROSS JOIN g GROUP BY 1, 2, 3)"""


def _sides(spark, d):
    e = B.embedded(spark, d)
    q = e.where("label <= 5").withColumn("side", F.when(F.col("label") <= 2, "anomaly").otherwise("rare"))
    return q, e.where("label >= 6").withColumn("method", F.when(F.col("label") <= 7, "m67").otherwise("m89"))


@query(f"WITH {EMB} SELECT query_id, round(min(d), 6) AS distance FROM dist GROUP BY 1")
def nearest_distance(spark, d):
    q, g = _sides(spark, d)
    return scoring.min_distances(q, g).select("query_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {EMB}, tau AS (SELECT quantile_cont(d, 0.4) AS tau FROM (SELECT min(d) AS d FROM dist WHERE side = 'anomaly' GROUP BY query_id)) SELECT round(tau, 6) AS tau FROM tau")
def choose_tau(spark, d):
    q, g = _sides(spark, d)
    return scoring.choose_tau(scoring.min_distances(q.where("side = 'anomaly'"), g), 0.4).select(*r6("tau"))


@query(f"""WITH {EMB}, a AS (SELECT method, side, avg(CAST(d <= 6.0 AS INTEGER)) AS cov, 1 / (1 + avg(d)) AS arp FROM dist GROUP BY 1, 2)
SELECT method, round(max(cov) FILTER (side = 'anomaly'), 6) AS coverage_anomaly, round(max(arp) FILTER (side = 'anomaly'), 6) AS arp_anomaly, round(max(cov) FILTER (side = 'rare'), 6) AS coverage_rare, round(max(arp) FILTER (side = 'rare'), 6) AS arp_rare, round(max(cov) FILTER (side = 'anomaly') - max(cov) FILTER (side = 'rare'), 6) AS gap FROM a GROUP BY 1""")
def coverage_arp_gap(spark, d):
    q, g = _sides(spark, d)
    near = scoring.min_distances(q, g, "method").join(q.select("query_id", "side"), "query_id")
    s = scoring.score_generator(near.where("side = 'anomaly'"), near.where("side = 'rare'"), 6.0)
    return s.select("method", *r6("coverage_anomaly", "arp_anomaly", "coverage_rare", "arp_rare", "gap"))


@query("SELECT round(avg(sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: pow(p[1] - p[2], 2))))), 6) AS diversity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.label >= 6 AND b.label >= 6")
def diversity(spark, d):
    return scoring.mean_pairwise(_sides(spark, d)[1]).select(*r6("diversity"))


@query()
def edi_union(spark, d):
    return scoring.edi(_sides(spark, d)[1]).select("method", *r6("edi"))


_WIN = "m AS (SELECT ['ours', 'unguided', 'genias', 'posthoc'][label - 5] AS method, avg(CAST(embedding[1] AS DOUBLE)) AS gap, avg(CAST(embedding[2] > -1.5 AS INTEGER)) AS occupancy, stddev_pop(CAST(embedding[3] AS DOUBLE)) AS diversity FROM embeddings WHERE label >= 6 GROUP BY 1)"


@query(f"""WITH {_WIN}, o AS (SELECT max(gap) FILTER (method = 'ours') AS gap, max(occupancy) FILTER (method = 'ours') AS occ, max(diversity) FILTER (method = 'ours') / max(diversity) FILTER (method = 'unguided') AS ratio, max(gap) FILTER (method <> 'ours') AS best FROM m)
SELECT round(gap, 6) AS gap, round(ratio, 6) AS diversity_ratio, occ >= 0.8 AS occupancy_ok, ratio >= 0.8 AS diversity_ok, gap > best AS beats_all, occ >= 0.8 AND ratio >= 0.8 AND gap > best AS won FROM o""")
def win_rule(spark, d):
    """Each class of the gallery stands for a method; statistics of its coordinates for its scores."""
    e = B.table(spark, d, "embeddings").where("label >= 6").withColumn("method", F.element_at(F.array(*map(F.lit, ("ours", "unguided", "genias", "posthoc"))), (F.col("label") - 5).cast("int")))
    x = lambda k: F.col("embedding")[k].cast("double")
    scores = e.groupBy("method").agg(F.avg(x(0)).alias("gap"), F.avg((x(1) > -1.5).cast("double")).alias("occupancy"), F.stddev_pop(x(2)).alias("diversity"))
    w = scoring.win_rule(scores, "ours", ["unguided", "genias", "posthoc"])
    return w.select(*r6("gap", "diversity_ratio"), "occupancy_ok", "diversity_ok", "beats_all", "won")


# --- fidelity ---

SIDES = f"""{ALL}, {STATS}, {POSTHOC}, {B.SCALER},
real AS (SELECT donor_id, l.channel_idx, t, (v - lo) / greatest(hi - lo, 1e-12) AS v FROM long l JOIN scaler USING (channel_idx)),
synth AS (SELECT donor_id, m.channel_idx, t, (y - lo) / greatest(hi - lo, 1e-12) AS v FROM made m JOIN scaler USING (channel_idx))"""
W1 = """cw AS (SELECT g, v, sum(r) AS r, sum(s) AS s FROM (SELECT g, v, 1 AS r, 0 AS s FROM rv UNION ALL SELECT g, v, 0, 1 FROM sv) GROUP BY 1, 2),
cc AS (SELECT g, v, sum(r) OVER (PARTITION BY g ORDER BY v) / sum(r) OVER (PARTITION BY g) - sum(s) OVER (PARTITION BY g ORDER BY v) / sum(s) OVER (PARTITION BY g) AS df, lead(v) OVER (PARTITION BY g ORDER BY v) - v AS dv FROM cw),
w1 AS (SELECT g, coalesce(sum(abs(df) * dv), 0) AS w1 FROM cc GROUP BY 1)"""


@query(f"WITH {SIDES}, rv AS (SELECT channel_idx AS g, v FROM real), sv AS (SELECT channel_idx AS g, v FROM synth), {W1} SELECT g AS channel_idx, round(w1, 6) AS w1 FROM w1")
def marginal_w1(spark, d):
    return fidelity.marginal_w1(*B.sides(spark, d)).select("channel_idx", *r6("w1"))


@query(f"""WITH {SIDES}, e AS (SELECT channel_idx, t, min(v) AS lo, CASE WHEN max(v) = min(v) THEN min(v) + 1e-5 ELSE max(v) END AS hi, count(*) AS nr FROM real WHERE t >= 1 GROUP BY 1, 2),
rb AS (SELECT channel_idx, t, least(19, floor((v - lo) / ((hi - lo) / 20))) AS b, count(*) AS r FROM real JOIN e USING (channel_idx, t) GROUP BY 1, 2, 3),
sb AS (SELECT channel_idx, t, least(19, floor((v - lo) / ((hi - lo) / 20))) AS b, count(*) AS s FROM synth JOIN e USING (channel_idx, t) WHERE v >= lo AND v <= hi GROUP BY 1, 2, 3),
ns AS (SELECT channel_idx, t, count(*) AS ns, count(*) FILTER (v < lo OR v > hi) / count(*) AS o FROM synth JOIN e USING (channel_idx, t) GROUP BY 1, 2),
st AS (SELECT channel_idx, t, sum(abs(coalesce(r, 0) / nr - coalesce(s, 0) / ns) / ((hi - lo) / 20)) / 20 AS dd FROM (SELECT * FROM rb FULL JOIN sb USING (channel_idx, t, b)) JOIN e USING (channel_idx, t) JOIN ns USING (channel_idx, t) GROUP BY 1, 2)
SELECT channel_idx, round(avg(dd), 5) AS mdd, round(avg(o), 6) AS outside_frac FROM st JOIN ns USING (channel_idx, t) GROUP BY 1""")
def mdd(spark, d):
    m = fidelity.marginal_difference(*B.sides(spark, d), bins=20)
    return m.select("channel_idx", F.round("mdd", 5).alias("mdd"), F.round("outside_frac", 6).alias("outside_frac"))


_ACF = """SELECT a.channel_idx, b.t - a.t AS lag, avg(a.z * b.z) / any_value(va) AS acf FROM {z} a JOIN {z} b ON a.donor_id = b.donor_id AND b.t - a.t BETWEEN 0 AND 15 JOIN (SELECT channel_idx, avg(z * z) AS va FROM {z} GROUP BY 1) q ON q.channel_idx = a.channel_idx GROUP BY 1, 2"""


@query(f"WITH {SIDES}, zr AS (SELECT donor_id, channel_idx, t, v - avg(v) OVER (PARTITION BY channel_idx) AS z FROM real), zy AS (SELECT donor_id, channel_idx, t, v - avg(v) OVER (PARTITION BY channel_idx) AS z FROM synth), ar AS ({_ACF.format(z='zr')}), ay AS ({_ACF.format(z='zy')}) SELECT channel_idx, round(sqrt(sum(pow(ar.acf - ay.acf, 2))), 6) AS acd FROM ar JOIN ay USING (channel_idx, lag) GROUP BY 1")
def acd(spark, d):
    return fidelity.autocorrelation_difference(*B.sides(spark, d), lags=16).select("channel_idx", *r6("acd"))


_MOM = """SELECT donor_id, channel_idx, avg(c + m) AS mean, any_value(d) AS std, regr_slope(c, t) * {w} AS trend, avg(pow(c / d, 3)) AS skew, avg(pow(c / d, 4)) - 3 AS kurtosis, sum(c * nx) / sum(c * c) AS acf1 FROM (SELECT *, lead(c) OVER (PARTITION BY donor_id ORDER BY t) AS nx FROM (SELECT donor_id, channel_idx, t, v - avg(v) OVER (PARTITION BY donor_id) AS c, avg(v) OVER (PARTITION BY donor_id) AS m, stddev_pop(v) OVER (PARTITION BY donor_id) AS d FROM {x})) GROUP BY 1, 2"""
_UNP = "SELECT channel_idx || '|' || f AS g, v FROM (UNPIVOT ({m}) ON mean, std, trend, skew, kurtosis, acf1 INTO NAME f VALUE v)"


@query(f"WITH {SIDES}, rv AS ({_UNP.format(m=_MOM.format(x='real', w=W - 1))}), sv AS ({_UNP.format(m=_MOM.format(x='synth', w=W - 1))}), {W1} SELECT CAST(split_part(g, '|', 1) AS INTEGER) AS channel_idx, split_part(g, '|', 2) AS feature, round(w1, 5) AS w1 FROM w1")
def feature_w1(spark, d):
    return fidelity.feature_w1(*B.sides(spark, d)).select("channel_idx", "feature", F.round("w1", 5).alias("w1"))


_PEAKS = f"""k AS (SELECT unnest(generate_series(1, {W // 2})) AS k),
sp AS (SELECT side, donor_id, channel_idx, k, round(2 * sqrt(pow(sum(z * cos(2 * pi() * k * t / {W})), 2) + pow(sum(z * sin(2 * pi() * k * t / {W})), 2)) / {W}, 12) AS a
  FROM (SELECT side, donor_id, channel_idx, t, v - avg(v) OVER (PARTITION BY side, donor_id) AS z FROM (SELECT 'r' AS side, * FROM real UNION ALL SELECT 's', * FROM synth)) CROSS JOIN k GROUP BY 1, 2, 3, 4),
pk AS (SELECT side, donor_id, channel_idx, max(a) AS a, arg_max(k, (a, -k)) / {W // 2} AS b FROM sp GROUP BY 1, 2, 3),
pl AS (SELECT side, channel_idx || '|a' AS g, a AS v FROM pk UNION ALL SELECT side, channel_idx || '|b', b FROM pk), rv AS (SELECT g, v FROM pl WHERE side = 'r'), sv AS (SELECT g, v FROM pl WHERE side = 's')"""


@query(f"WITH {SIDES}, {_PEAKS}, {W1} SELECT CAST(split_part(g, '|', 1) AS INTEGER) AS channel_idx, round(max(w1) FILTER (g LIKE '%a'), 6) AS amplitude_w1, round(max(w1) FILTER (g LIKE '%b'), 6) AS frequency_w1 FROM w1 GROUP BY 1")
def fft_awd(spark, d):
    return fidelity.fft_distance(*B.sides(spark, d), W).select("channel_idx", *r6("amplitude_w1", "frequency_w1"))


@query()
def c2st(spark, d):
    """Windows that begin in one stretch of a window's width share a group."""
    real, synth = B.sides(spark, d)
    ids = lambda df: df.withColumns({"group_id": F.floor(F.col("donor_id") / W), "window_id": F.col("donor_id")})
    return fidelity.c2st_over_seeds(ids(real), ids(synth)).select(*r6("accuracy", "p_value", "reject_rate"), "n_test")


_CHANGED = f"sc AS (SELECT donor_id, y.channel_idx, family, t, (y - lo) / greatest(hi - lo, 1e-12) AS v FROM made y JOIN scaler USING (channel_idx))"


@query(f"""WITH {LONG}, {STATS}, {TAXONOMY}, {B.SCALER}, {_CHANGED}, real AS (SELECT donor_id, channel_idx, t, (v - lo) / greatest(hi - lo, 1e-12) AS v FROM long JOIN scaler USING (channel_idx)),
rv AS (SELECT family || '|' || channel_idx AS g, v FROM real CROSS JOIN (SELECT DISTINCT family FROM sc)), sv AS (SELECT family || '|' || channel_idx AS g, v FROM sc), {W1},
zr AS (SELECT donor_id, channel_idx, t, v - avg(v) OVER (PARTITION BY channel_idx) AS z FROM real), ar AS ({_ACF.format(z='zr')}),
zs AS (SELECT donor_id, family || '|' || channel_idx AS channel_idx, t, v - avg(v) OVER (PARTITION BY family, channel_idx) AS z FROM sc), ay AS ({_ACF.format(z='zs')}),
ac AS (SELECT ay.channel_idx AS g, sqrt(sum(pow(ar.acf - ay.acf, 2))) AS acd FROM ay JOIN ar ON ar.lag = ay.lag AND CAST(ar.channel_idx AS VARCHAR) = split_part(ay.channel_idx, '|', 2) GROUP BY 1)
SELECT split_part(g, '|', 1) AS method, round(avg(w1), 6) AS w1, round(avg(acd), 6) AS acd FROM w1 LEFT JOIN ac USING (g) GROUP BY 1""")
def metric_pivot(spark, d):
    """Each family of the taxonomy is a method; its channels' W1 and autocorrelation differences from the donors."""
    base, s = B.donors(spark, d).select("donor_id", "channel_idx", "x"), B.scaler(spark, d)
    made = scaling.span_normalise(inject.taxonomy(base, W, B.SEED), s)
    real = scaling.span_normalise(base, s)
    return selection.pivot_metrics(fidelity.method_metrics(real, made, "family"), ["w1", "acd"]).select("method", *r6("w1", "acd"))


# --- detection ---

DET = "s AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 3) AS score, CASE WHEN label <= 2 THEN 1 ELSE 0 END AS label, vec_id % 40 AS event_id FROM embeddings)"


def _scores(spark, d):
    return B.table(spark, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 3).alias("score"), (F.col("label") <= 2).cast("int").alias("label"), (F.col("vec_id") % 40).alias("event_id"))


@query(f"WITH {DET} SELECT round(quantile_cont(score, 0.9), 6) AS threshold FROM s WHERE label = 0")
def threshold_at_far(spark, d):
    return detection.threshold_at_far(_scores(spark, d).where("label = 0"), 0.1).select(*r6("threshold"))


@query(f"WITH {DET}, t AS (SELECT quantile_cont(score, 0.9) AS t FROM s WHERE label = 0), e AS (SELECT event_id, max(CAST(score >= t AS INTEGER)) AS hit FROM s, t WHERE label = 1 GROUP BY 1) SELECT round(avg(hit), 6) AS recall, count(*) AS n_events FROM e")
def event_recall(spark, d):
    s = _scores(spark, d)
    t = detection.threshold_at_far(s.where("label = 0"), 0.1)
    hits = detection.event_hits(s.where("label = 1").join(F.broadcast(t)), F.col("threshold"))
    return hits.agg(F.round(F.avg("hit"), 6).alias("recall"), F.count("*").alias("n_events"))


@query(f"WITH {DET}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auroc FROM r")
def auroc(spark, d):
    return detection.auroc(_scores(spark, d)).select(*r6("auroc"))


@query(f"WITH {DET}, c AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) AS n FROM s GROUP BY 1), k AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS n FROM c WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * tp / n) / sum(p), 6) AS average_precision FROM k")
def average_precision(spark, d):
    return detection.average_precision(_scores(spark, d)).select(*r6("average_precision"))


@query(f"""WITH {DET}, t AS (SELECT quantile_cont(score, 0.9) AS t FROM s WHERE label = 0), e AS (SELECT event_id, max(CAST(score >= t AS INTEGER)) AS hit FROM s, t WHERE label = 1 GROUP BY 1),
i AS (SELECT hit, row_number() OVER (ORDER BY {B.h(B.SEED, 'event_id')}, event_id) - 1 AS i, count(*) OVER () AS n FROM e), dr AS (SELECT boot, {B.h(B.SEED, 'boot', 'i')} % n AS i FROM i CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS boot)),
r AS (SELECT boot, avg(hit) AS r FROM dr JOIN i USING (i) GROUP BY 1) SELECT round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM r""")
def bootstrap_recall(spark, d):
    s = _scores(spark, d)
    t = detection.threshold_at_far(s.where("label = 0"), 0.1)
    return detection.bootstrap_recall(detection.event_hits(s.where("label = 1").join(F.broadcast(t)), F.col("threshold")), 200, B.SEED).select(*r6("median", "low", "high"))


@query(f"""WITH {DET}, r AS (SELECT 'arm' || (vec_id % 2) AS arm, vec_id % 3 AS fold, vec_id % 5 AS seed, event_id, CAST(score > 0 AS INTEGER) AS hit, vec_id % 3 = 0 AS leaked FROM s WHERE label = 1),
a AS (SELECT arm, seed, avg(h) AS r FROM (SELECT arm, seed, event_id, max(hit) AS h FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2), c AS (SELECT arm, seed, avg(h) AS r FROM (SELECT arm, seed, event_id, max(hit) AS h FROM r WHERE NOT leaked GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT * FROM (SELECT arm, round(quantile_cont(r, 0.5), 6) AS recall_median, round(avg(r), 6) AS recall_mean, round(min(r), 6) AS recall_min, round(max(r), 6) AS recall_max FROM a GROUP BY 1) LEFT JOIN (SELECT arm, round(quantile_cont(r, 0.5), 6) AS clean_median, round(avg(r), 6) AS clean_mean, round(min(r), 6) AS clean_min, round(max(r), 6) AS clean_max FROM c GROUP BY 1) USING (arm)""")
def arm_recall(spark, d):
    v = F.col("vec_id")
    rows = _scores(spark, d).where("label = 1").select(F.concat(F.lit("arm"), (v % 2).cast("string")).alias("arm"), (v % 3).alias("fold"), (v % 5).alias("seed"), "event_id", (F.col("score") > 0).cast("int").alias("hit"), (v % 3 == 0).alias("leaked"))
    a = detection.aggregate_arms(rows)
    return a.select("arm", *r6(*[c for c in a.columns if c != "arm"]))


# --- energies ---

ENE = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label <= 2), r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS kind FROM embeddings WHERE label >= 6),
d2 AS (SELECT query_id, kind, list_sum(list_transform(list_zip(q.x, r.x), lambda p: pow(p[1] - p[2], 2))) AS d2 FROM q CROSS JOIN r)"""


def _energies(spark, d):
    e = B.embedded(spark, d)
    return energy.energies(e.where("label <= 2"), e.where("label >= 6"), 2.0, 8, "label")


@query(f"WITH {ENE}, m AS (SELECT query_id, min(d2) AS m FROM d2 GROUP BY 1) SELECT query_id, round(-2.0 * (-any_value(m) / 2.0 + ln(sum(exp((m - d2) / 2.0)))), 5) AS energy FROM d2 JOIN m USING (query_id) GROUP BY 1")
def soft_energy(spark, d):
    return _energies(spark, d).select("query_id", F.round("soft", 5).alias("energy"))


@query(f"WITH {ENE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2) AS rk, min(d2) OVER (PARTITION BY query_id) AS m FROM d2) SELECT query_id, round(-2.0 * (-any_value(m) / 2.0 + ln(sum(exp((m - d2) / 2.0)))), 5) AS energy, round(any_value(m), 5) AS nearest FROM k WHERE rk <= 8 GROUP BY 1")
def knn_energy(spark, d):
    return _energies(spark, d).select("query_id", F.round("knn", 5).alias("energy"), F.round("nearest", 5).alias("nearest"))


@query(f"WITH {ENE}, m AS (SELECT query_id, min(d2) AS m FROM d2 GROUP BY 1), k AS (SELECT query_id, kind, any_value(m) AS m, avg(exp((m - d2) / 2.0)) AS a FROM d2 JOIN m USING (query_id) GROUP BY 1, 2) SELECT query_id, round(-2.0 * (-any_value(m) / 2.0 + ln(avg(a))), 5) AS energy FROM k GROUP BY 1")
def kind_soft_energy(spark, d):
    return _energies(spark, d).select("query_id", F.round("balanced", 5).alias("energy"))


@query("""WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label = 9), p AS (SELECT list_sum(list_transform(list_zip(a.x, b.x), lambda p: pow(p[1] - p[2], 2))) AS d2 FROM r a JOIN r b ON a.vec_id < b.vec_id),
t AS (SELECT greatest(sqrt(quantile_disc(d2, 0.5)), 1e-3) AS tau FROM p), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label = 8),
d AS (SELECT v.vec_id AS q, list_sum(list_transform(list_zip(v.x, r.x), lambda p: pow(p[1] - p[2], 2))) AS d2 FROM v CROSS JOIN r), m AS (SELECT q, min(d2) AS m FROM d GROUP BY 1),
h AS (SELECT q, -any_value(tau) * (-any_value(m) / any_value(tau) + ln(sum(exp((m - d2) / tau)))) AS h FROM d JOIN m USING (q), t GROUP BY 1)
SELECT round(any_value(tau), 5) AS tau, round(quantile_cont(h, 0.99), 4) AS q_value, round(greatest(0.25 * greatest(quantile_cont(h, 0.75) - quantile_cont(h, 0.25), 1e-6), 1e-4), 5) AS delta, round(avg(h), 4) AS h_mean, round(stddev_pop(h), 5) AS h_std FROM h, t""")
def shell_fit(spark, d):
    e = B.embedded(spark, d)
    s = energy.shell(e.where("label = 9"), e.where("label = 8"))
    return s.select(*[F.round(c, k).alias(c) for c, k in (("tau", 5), ("q_value", 4), ("delta", 5), ("h_mean", 4), ("h_std", 5))])


@query(f"WITH {ENE}, h AS (SELECT query_id, min(d2) AS h FROM d2 GROUP BY 1) SELECT count(*) AS n, round(avg(h), 5) AS mean, round(stddev_pop(h), 5) AS std, round(avg(CAST(abs(h - 40) <= 5 AS INTEGER)), 6) AS frac_in_band, round(avg(CAST(h < 35 AS INTEGER)), 6) AS frac_below, round(avg(CAST(h > 45 AS INTEGER)), 6) AS frac_above FROM h")
def band_report(spark, d):
    r = energy.band_report(_energies(spark, d), 40.0, 5.0, "nearest")
    return r.select("n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), *r6("frac_in_band", "frac_below", "frac_above"))


# --- model stage ---


@query("WITH b AS (SELECT CAST(i AS INTEGER) AS t, 1e-4 + i * ((0.02 - 1e-4) / 199) AS beta FROM (SELECT unnest(generate_series(0, 199)) AS i)) SELECT t, round(beta, 9) AS beta, round(exp(sum(ln(1 - beta)) OVER (ORDER BY t)), 9) AS alpha_bar FROM b")
def beta_schedule(spark, d):
    return models.Schedule().rows(spark).select("t", F.round("beta", 9).alias("beta"), F.round("alpha_bar", 9).alias("alpha_bar"))


def _g(p: str) -> str:
    u = lambda s: f"((CAST('0x' || substr(md5('{B.SEED}:' || donor_id || ':' || t || ':{s}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"
    return f"sqrt(-2 * ln({u('a')})) * cos(2 * pi() * {u('b')})"


@query(f"WITH {LONG} SELECT donor_id, round(sum(sqrt(0.5) * v + sqrt(0.5) * {_g('')}), 5) AS total FROM long GROUP BY 1")
def q_sample(spark, d):
    return models.q_sample(B.donors(spark, d), 0.5, B.SEED).select("donor_id", F.round(A.total(F.col("x")), 5).alias("total"))


def _scaled(spark, d):
    s = B.scaler(spark, d)
    return scaling.transform(B.finite(spark, d), s, (-1.0, 1.0)), models.with_parent(scaling.transform(B.donors(spark, d), s, (-1.0, 1.0)))


@query()
def ddim_unguided(spark, d):
    train, base = _scaled(spark, d)
    out = models.ddim(base, models.fit_gaussians(train), nu=0.2, steps=20, seed=B.SEED)
    return out.select("donor_id", "channel_idx", F.round(A.mean(F.col("x")), 4).alias("mean"))


def guide_references(base, most=64):
    """About ``most`` donors, equally many of each channel and one at least: the first in the keyed hash order of their ids."""
    n = base.select("channel_idx").distinct().count()
    return base.where(F.pmod("donor_id", F.lit(B.DONORS)) < -(-most // max(1, n)))


@query()
def ddim_guided(spark, d):
    train, base = _scaled(spark, d)
    basis, centre = models.fit_encoder(train, 4)
    refs = (energy.references(guide_references(base))[0] - centre) @ basis
    guide = models.Guide(basis, centre, refs, 1.0, 1.0, 0.3)
    out = models.ddim(base, models.fit_gaussians(train), nu=0.2, steps=20, seed=B.SEED, guide=guide)
    return out.select("donor_id", "channel_idx", F.round(A.mean(F.col("x")), 4).alias("mean"))


@query()
def ppca_inflate(spark, d):
    train, base = _scaled(spark, d)
    return models.ppca_inflate(base, models.fit_gaussians(train), seed=B.SEED).select("donor_id", "channel_idx", F.round(A.mean(F.col("x")), 4).alias("mean"))


# --- selection over a grid of cells ---

_VALUES = """g AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS family, c_acctbal >= 0 AS finite, c_nationkey = 0 AS explode, (c_custkey % 100) / 100.0 :: DOUBLE AS occupancy, round(CAST(c_acctbal AS DOUBLE) / 10000, 6) AS arp,
  (c_custkey % 7) / 10.0 :: DOUBLE AS lam, 0.5 + (c_custkey % 13) / 10.0 :: DOUBLE AS tv, 0.5 + (c_custkey % 11) / 10.0 :: DOUBLE AS ratio FROM customer)"""


def _cells(spark, d):
    """Customers stand for tuned cells, market segments for families."""
    k, n = F.col("c_custkey"), lambda m, s: (F.col("c_custkey") % m).cast("double") / s
    return B.table(spark, d, "customer").select(
        k.cast("string").alias("id"), F.col("c_mktsegment").alias("family"), (F.col("c_acctbal") >= 0).alias("finite"), (F.col("c_nationkey") == 0).alias("explode"), n(100, 100.0).alias("occupancy"),
        F.round(F.col("c_acctbal").cast("double") / 10000, 6).alias("arp"), n(7, 10.0).alias("lam"), (0.5 + n(13, 10.0)).alias("tv"), (0.5 + n(11, 10.0)).alias("ratio"),
    )


@query(f"WITH {_VALUES} SELECT family, id, arp FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY arp DESC, id) AS k FROM g WHERE finite AND NOT explode) WHERE k = 1")
def pick_winners(spark, d):
    return selection.pick_winners(_cells(spark, d), "arp").select("family", "id", "arp")


@query(f"WITH {_VALUES} SELECT family, id, round(e, 6) AS excess FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY occupancy >= 0.5 DESC, e, occupancy DESC, arp DESC, lam, id) AS k FROM (SELECT *, greatest(tv - 1, 0) AS e FROM g)) WHERE k = 1")
def recommend_lambda(spark, d):
    return selection.recommend(_cells(spark, d), 1.0, by="family").select("family", "id", *r6("excess"))


@query(f"WITH {_VALUES} SELECT family, id, round(e, 6) AS error FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY occupancy >= 0.5 DESC, e, occupancy DESC, lam, id) AS k FROM (SELECT *, abs(tv - 1.0) + abs(ratio - 1.0) AS e FROM g)) WHERE k = 1")
def recommend_quiet(spark, d):
    return selection.recommend_quiet(_cells(spark, d), 1.0, 1.0, by="family").select("family", "id", *r6("error"))


