"""Queries of slices, detector reports, audits, distributions, picks and scouting."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import spectral
from orrery.operators import detection, events, fidelity, folds, inject, panel, reports, scoring
from orrery.plans import analytics as N
from orrery.plans import bindings as B
from orrery.plans import relational as R
from orrery.plans.registry import query

W = B.WIDTH
r6 = N.r6


@N.whole(f"""WITH {N.ALL}, {N.STATS}, c AS (SELECT donor_id, t, v - m AS c FROM long JOIN s USING (donor_id))
SELECT a.donor_id, CAST(b.t - a.t AS INTEGER) AS lag, round(sum(a.c * b.c) / any_value(p), 6) AS acf FROM c a JOIN c b ON a.donor_id = b.donor_id AND b.t - a.t BETWEEN 0 AND 7 JOIN (SELECT donor_id, sum(c * c) AS p FROM c GROUP BY 1) q ON q.donor_id = a.donor_id GROUP BY 1, 2""")
def acf_rows(spark, d):
    rows = B.every(spark, d).select("window_id", F.posexplode(A.acf(F.col("x"), 8)).alias("lag", "acf"))
    return rows.select("window_id", "lag", F.round("acf", 6).alias("acf"))


_BANDS = f"bands AS (SELECT donor_id, CASE WHEN k < {(W // 2 + 1) // 4} THEN 0 WHEN k < {(W // 2 + 1) * 2 // 4} THEN 1 WHEN k < {(W // 2 + 1) * 3 // 4} THEN 2 ELSE 3 END AS b, avg(re * re + im * im) + 1e-8 AS e FROM dft GROUP BY 1, 2)"


@N.whole(f"""WITH {N.ALL}, {N.STATS}, zs AS (SELECT long.*, (v - m) / CASE WHEN d < 1e-8 THEN 1 ELSE d END AS z FROM long JOIN s USING (donor_id)), {N.DFT}, {_BANDS}
SELECT donor_id, round(sum(e) FILTER (b >= 2) / sum(e) FILTER (b < 2), 5) AS hf_lf FROM bands GROUP BY 1""")
def hf_lf_ratio(spark, d):
    return B.every(spark, d).withColumn("b", spectral.log_bands("x")).select("window_id", F.round(A.hf_lf(F.col("b")), 5).alias("hf_lf"))


@query(f"""WITH {N.LONG}, {N.STATS}, {N.POSTHOC}, p AS (SELECT donor_id, v - avg(v) OVER (PARTITION BY donor_id) AS a, y - avg(y) OVER (PARTITION BY donor_id) AS b FROM long JOIN made USING (donor_id, t))
SELECT donor_id, round(1 - sum(pow(a - b, 2)) / sum(a * a), 5) AS r2, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS corr FROM p GROUP BY 1""")
def shape_scores(spark, d):
    base = B.donors(spark, d)
    both = base.select("donor_id", F.col("x").alias("a")).join(inject.posthoc(base, W, B.SEED).select("donor_id", F.col("x").alias("b")), "donor_id")
    return both.select("donor_id", A.shape_scores(F.col("a"), F.col("b")).alias("s")).select("donor_id", F.round("s.r2", 5).alias("r2"), F.round("s.corr", 6).alias("corr"))


@query(f"""WITH {B.KINDED}, s AS (SELECT kind_name, {B.AMP} AS a, {B.SHIFT} AS m FROM kinded)
SELECT kind_name, count(*) AS n, round(avg(CAST(a >= 150 AS INTEGER)), 6) AS amp_rate, round(avg(CAST(m >= 5 AS INTEGER)), 6) AS shift_rate, round(quantile_cont(a, 0.5), 6) AS amp_median, round(quantile_cont(m, 0.5), 6) AS shift_median FROM s GROUP BY 1""")
def kind_slice_metrics(spark, d):
    m = reports.slice_metrics(B.kinded(spark, d), "kind_name", 150.0, 5.0)
    return m.select("kind_name", "n", *r6("amp_rate", "shift_rate", "amp_median", "shift_median"))


@query(f"""WITH {N.LONG}, {N.STATS}, zs AS (SELECT long.*, (v - m) / CASE WHEN d < 1e-8 THEN 1 ELSE d END AS z FROM long JOIN s USING (donor_id)), {N.DFT}, {_BANDS},
r AS (SELECT donor_id, sum(e) FILTER (b >= 2) / sum(e) FILTER (b < 2) AS r FROM bands GROUP BY 1),
t AS (SELECT donor_id, {B.KINDS!r}[(ntile({len(B.KINDS)}) OVER (PARTITION BY channel_idx ORDER BY {B.h(B.SEED, 'donor_id')}, donor_id) - 1 + dense_rank() OVER (ORDER BY channel_idx) - 1) % {len(B.KINDS)} + 1] AS kind_alloc FROM donors)
SELECT kind_alloc, count(*) AS n, round(quantile_cont(r, 0.5), 5) AS hf_lf_median FROM r JOIN t USING (donor_id) GROUP BY 1""")
def spectrum_slices(spark, d):
    from orrery.operators import kinds

    rows = kinds.alloc_stratified(B.donors(spark, d), B.KINDS, B.SEED).withColumn("bands", spectral.log_bands("x"))
    return reports.spectrum_slices(rows).select("kind_alloc", "n", F.round("hf_lf_median", 5).alias("hf_lf_median"))


@query(f"""WITH {N.LONG}, {N.STATS}, {N.POSTHOC}, w AS (SELECT donor_id, max(y) - min(y) >= 150 AS a, abs(avg(y) FILTER (t < {W // 2}) - avg(y) FILTER (t >= {W // 2})) >= 5 AS d FROM made GROUP BY 1)
SELECT count(*) AS n, coalesce(round(avg(CAST(d AS INTEGER)), 6), 0.0) AS shift_frac, coalesce(round(avg(CAST(a AND NOT d AS INTEGER)), 6), 0.0) AS spike_frac, coalesce(round(avg(CAST(NOT a AND NOT d AS INTEGER)), 6), 0.0) AS subtle_frac FROM w""")
def kind_hits(spark, d):
    h = reports.kind_hits(inject.posthoc(B.donors(spark, d), W, B.SEED), 150.0, 5.0)
    return h.select("n", *r6("shift_frac", "spike_frac", "subtle_frac"))


@query(f"WITH {N.EMB}, n AS (SELECT query_id, min(d) AS d FROM dist GROUP BY 1) SELECT CAST(label AS INTEGER) AS kind, count(*) AS n, round(avg(CAST(d <= 6.0 AS INTEGER)), 6) AS coverage, round(1 / (1 + avg(d)), 6) AS arp FROM n JOIN embeddings ON vec_id = query_id GROUP BY 1")
def kind_coverage(spark, d):
    q, g = N._sides(spark, d)
    near = scoring.min_distances(q, g).join(q.select("query_id", F.col("label").cast("int").alias("kind")), "query_id")
    return reports.coverage_by_slice(near, 6.0, "kind").select("kind", "n", *r6("coverage", "arp"))


@query(f"WITH {N.EMB} SELECT method, count(*) AS n, round(avg(CAST(d <= 6.0 AS INTEGER)), 6) AS coverage, round(1 / (1 + avg(d)), 6) AS arp FROM dist WHERE side = 'anomaly' GROUP BY 1")
def slice_coverage(spark, d):
    """The same queries against each slice of the gallery alone."""
    q, g = N._sides(spark, d)
    return reports.coverage_by_slice(scoring.min_distances(q.where("side = 'anomaly'"), g, "method"), 6.0, "method").select("method", "n", *r6("coverage", "arp"))


@query(f"""WITH {N.SIDES}, bo AS (SELECT 'real' AS source, * FROM real UNION ALL SELECT 'posthoc', * FROM synth),
w AS (SELECT source, donor_id, max(v) - min(v) AS amplitude, sum(a) / {W - 1} AS tv FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY source, donor_id ORDER BY t)) AS a FROM bo) GROUP BY 1, 2),
l AS (SELECT source, 'amplitude' AS metric, amplitude AS v FROM w UNION ALL SELECT source, 'tv', tv FROM w)
SELECT source, metric, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95 FROM l GROUP BY 1, 2""")
def diagnostic_summary(spark, d):
    real, synth = B.sides(spark, d)
    rows = real.select(F.lit("real").alias("source"), "x").unionByName(synth.select(F.lit("posthoc").alias("source"), "x"))
    rows = rows.select("source", A.amplitude(F.col("x")).alias("amplitude"), A.total_variation(F.col("x")).alias("tv"))
    return reports.diagnostics(rows, ["source"], ["amplitude", "tv"]).select("source", "metric", "n", *r6("mean", "median", "p05", "p95"))


@query(f"WITH {B.FINITE}, a AS (SELECT channel_idx, round({B.AMP}, 3) AS excess FROM finite) SELECT DISTINCT channel_idx, excess, round(cume_dist() OVER (PARTITION BY channel_idx ORDER BY excess), 6) AS share FROM a")
def excess_ecdf(spark, d):
    rows = B.finite(spark, d).select("channel_idx", F.round(A.amplitude(F.col("x")), 3).alias("excess"))
    return reports.ecdf(rows, "channel_idx", "excess").select("channel_idx", "excess", F.round("share", 6).alias("share"))


_BOTH = f"""{B.LABELED}, {B.OCCUPIED}, nominal AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY channel_idx ORDER BY {B.h(B.SEED, 'channel_idx', 'start')}, start) AS rk FROM finite f, size WHERE start + {W} <= n AND NOT EXISTS (SELECT 1 FROM occ WHERE occ.channel_idx = f.channel_idx AND occ.bin BETWEEN f.start AND f.start + {W - 1})) WHERE rk <= {B.PER_CHANNEL})"""


@query(f"""WITH {_BOTH}, l AS (SELECT channel, count(*) FILTER (is_anomaly) AS a, count(*) FILTER (is_rare) AS r FROM labeled GROUP BY 1), m AS (SELECT channel, count(*) AS n FROM nominal GROUP BY 1)
SELECT dim.channel, coalesce(a, 0) AS n_anomaly, coalesce(r, 0) AS n_rare, coalesce(m.n, 0) AS n_nominal, coalesce(a, 0) < 5 AS few FROM dim LEFT JOIN l USING (channel) LEFT JOIN m USING (channel)""")
def channel_totals(spark, d):
    return reports.channel_totals(B.labeled(spark, d), B.nominal(spark, d), panel.channels(B.raw(spark, d)))


@query(f"WITH {B.KINDED} SELECT kind_name, count(*) AS n FROM kinded GROUP BY 1")
def kind_counts(spark, d):
    return reports.counts(B.kinded(spark, d), "kind_name")


@query(f"WITH {B.KINDED}, g AS (SELECT kind_name, count(*) AS n_all, count(*) FILTER (fold <> 0) AS n_oof FROM kinded GROUP BY 1) SELECT kind_name, n_all, n_oof, CAST(least(20, CASE WHEN n_oof = 0 THEN n_all ELSE n_oof END) AS BIGINT) AS n_ref, n_oof = 0 AS leaked FROM g")
def kind_reference_counts(spark, d):
    return reports.reference_counts(B.kinded(spark, d), 0, 20)


@query(f"WITH {N.LONG}, {N.STATS}, {N.POSTHOC}, f AS (SELECT unnest(['step', 'pulse', 'ramp', 'scale', 'trend']) AS family), c AS (SELECT family, count(DISTINCT donor_id) AS n FROM made GROUP BY 1) SELECT family, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (family)")
def family_counts(spark, d):
    every = spark.createDataFrame([(f,) for f in (*inject.POSTHOC, "trend")], "family string")
    return reports.counts(inject.posthoc(B.donors(spark, d), W, B.SEED), "family", every)


@query(f"""WITH {B.FOLDED}, {R._COUNTS}, m AS (SELECT f.channel, f.fold, {B.SHIFT.replace('x[', 'f.x[')} AS d, NOT below_min AS kept FROM folded f JOIN counts c ON c.channel = f.channel AND c.fold = f.fold),
s AS (SELECT fold, bool_or(kept) AS held FROM m GROUP BY 1)
SELECT fold, count(*) AS n, round(avg(CAST(d <= 5 AS INTEGER)), 6) AS coverage, round(1 / (1 + avg(d)), 6) AS arp, bool_and(NOT held) AS unfiltered FROM m JOIN s USING (fold) WHERE kept OR NOT held GROUP BY 1""")
def fold_scores(spark, d):
    """Level shifts stand for distances here."""
    f = B.folded(spark, d)
    keep = folds.channel_fold_counts(f, B.LEAST, B.N_FOLDS).where("NOT below_min")
    near = f.select("channel", "fold", A.level_shift(F.col("x")).alias("distance"))
    return reports.fold_scores(near, keep, 5.0).select("fold", "n", *r6("coverage", "arp"), "unfiltered")


DET = "s AS (SELECT vec_id, label AS kind, round(CAST(embedding[1] AS DOUBLE), 3) AS score, CASE WHEN label <= 2 THEN 1 ELSE 0 END AS label, CASE WHEN label BETWEEN 3 AND 5 THEN 'rare' ELSE 'nominal' END AS side, vec_id % 40 AS event_id FROM embeddings), th AS (SELECT quantile_cont(score, 0.9) AS th FROM s WHERE label = 0 AND side = 'nominal')"


def _scores(spark, d):
    e = B.table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").cast("int").alias("kind"), F.round(F.col("embedding")[0].cast("double"), 3).alias("score"), (F.col("label") <= 2).cast("int").alias("label"), F.when(F.col("label").between(3, 5), "rare").otherwise("nominal").alias("side"), (F.col("vec_id") % 40).alias("event_id"))


@query(f"""WITH {DET}, q AS (SELECT * FROM s WHERE label = 1 OR side = 'nominal'),
c AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) AS n FROM q GROUP BY 1), k AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS n FROM c WINDOW w AS (ORDER BY score DESC)),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM q),
e AS (SELECT event_id, max(CAST(score >= th AS INTEGER)) AS hit FROM s, th WHERE label = 1 GROUP BY 1)
SELECT round((SELECT th FROM th), 6) AS threshold, round((SELECT avg(hit) FROM e), 6) AS recall, (SELECT count(*) FROM e) AS n_events,
  (SELECT round(avg(CAST(score >= th AS INTEGER)), 6) FROM s, th WHERE label = 0 AND side = 'nominal') AS far, (SELECT round(avg(CAST(score >= th AS INTEGER)), 6) FROM s, th WHERE side = 'rare') AS rare_far,
  (SELECT round(sum(p * tp / n) / sum(p), 6) FROM k) AS average_precision,
  (SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) FROM r) AS auroc""")
def detector_report(spark, d):
    e = detection.evaluate(_scores(spark, d), 0.1)
    return e.select(*r6("threshold", "recall"), "n_events", *r6("far", "rare_far", "average_precision", "auroc"))


@query(f"WITH {DET}, e AS (SELECT kind, event_id, max(CAST(score >= th AS INTEGER)) AS e, sum(CAST(score >= th AS INTEGER)) AS h, count(*) AS n FROM s, th WHERE label = 1 GROUP BY 1, 2) SELECT CAST(kind AS INTEGER) AS kind, count(*) AS n_events, CAST(sum(n) AS BIGINT) AS n_windows, round(avg(e), 6) AS recall, round(sum(h) / sum(n), 6) AS window_recall FROM e GROUP BY 1")
def detector_by_kind(spark, d):
    s = _scores(spark, d)
    t = detection.threshold_at_far(s.where("label = 0 AND side = 'nominal'"), 0.1)
    k = detection.recall_by_kind(s.where("label = 1"), t)
    return k.select("kind", "n_events", "n_windows", *r6("recall", "window_recall"))


@query(f"""WITH {N.SIDES}, rv AS (SELECT channel_idx AS g, v FROM real), sv AS (SELECT channel_idx AS g, v FROM synth), {N.W1},
zr AS (SELECT donor_id, channel_idx, t, v - avg(v) OVER (PARTITION BY channel_idx) AS z FROM real), zy AS (SELECT donor_id, channel_idx, t, v - avg(v) OVER (PARTITION BY channel_idx) AS z FROM synth), ar AS ({N._ACF.format(z='zr')}), ay AS ({N._ACF.format(z='zy')}),
ac AS (SELECT channel_idx, sqrt(sum(pow(ar.acf - ay.acf, 2))) AS acd FROM ar JOIN ay USING (channel_idx, lag) GROUP BY 1), n AS (SELECT channel_idx, count(*) // {W} AS n FROM real GROUP BY 1)
SELECT channel_idx, n AS n_real, n AS n_synth, CASE WHEN n >= 32 THEN 'evidence' ELSE 'descriptive' END AS tier, round(w1, 6) AS w1, round(acd, 6) AS acd FROM n LEFT JOIN ac USING (channel_idx) LEFT JOIN w1 ON g = channel_idx""")
def realism_audit(spark, d):
    return fidelity.audit(*B.sides(spark, d)).select("channel_idx", "n_real", "n_synth", "tier", *r6("w1", "acd"))


@query(f"""WITH {B.DONOR}, f AS (SELECT donor_id FROM donors ORDER BY round({B.AMP}, 9) DESC, donor_id LIMIT 8)
SELECT donor_id, true AS extreme FROM f UNION ALL SELECT * FROM (SELECT donor_id, false FROM donors WHERE donor_id NOT IN (SELECT donor_id FROM f) ORDER BY {B.h(B.SEED, 'donor_id')}, donor_id LIMIT 8)""")
def pick_mixed(spark, d):
    return reports.pick_mixed(B.donors(spark, d), 16, B.SEED).select("donor_id", "extreme")


@query(f"WITH {B.DONOR} SELECT channel_idx, min(donor_id) AS donor_id FROM donors GROUP BY 1 ORDER BY 1 LIMIT 4")
def one_per_channel(spark, d):
    return reports.one_per_channel(B.donors(spark, d), 4)


@query(f"WITH {B.DONOR} SELECT donor_id FROM donors ORDER BY {B.h(B.SEED, 'donor_id')}, donor_id LIMIT 50")
def subsample(spark, d):
    return reports.subsample(B.donors(spark, d), 50, B.SEED).select("donor_id")


@query(f"WITH {B.DONOR} SELECT channel_idx, donor_id FROM (SELECT *, row_number() OVER (PARTITION BY channel_idx ORDER BY {B.h(B.SEED, 'donor_id')}, donor_id) AS k FROM donors) WHERE k <= 12")
def balanced_batch(spark, d):
    return reports.balanced_batch(B.donors(spark, d), "channel_idx", 12, B.SEED).select("channel_idx", "donor_id")


@query(f"WITH {N.LONG}, {N.STATS}, {N.POSTHOC} SELECT family AS cell, count(DISTINCT donor_id) AS n, true AS finite, bool_or(abs(y) > 250) AS explode FROM made GROUP BY 1")
def finite_gate(spark, d):
    return reports.finite_gate(inject.posthoc(B.donors(spark, d), W, B.SEED).withColumnRenamed("family", "cell"), 250.0)


_RANK = "(SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM (SELECT CAST(embedding[{k}] AS DOUBLE) AS s, CASE WHEN label <= 2 THEN 1 ELSE 0 END AS y FROM embeddings WHERE {where})))"
_ENC = " UNION ALL ".join(f"SELECT 'e{k}' AS encoder, {_RANK.format(k=k, where='label <= 5')} AS auroc_ar, {_RANK.format(k=k, where='label <= 2 OR label >= 6')} AS auroc_an" for k in (1, 2, 3))


@query(f"SELECT encoder, round(auroc_ar, 6) AS auroc_ar, round(auroc_an, 6) AS auroc_an, CAST(row_number() OVER (ORDER BY auroc_ar DESC, auroc_an DESC, encoder) AS INTEGER) AS rank FROM ({_ENC})")
def rank_encoders(spark, d):
    """The first coordinates stand for encoders."""
    e, out = B.table(spark, d, "embeddings"), None
    for k in range(3):
        s = e.select("label", F.col("embedding")[k].cast("double").alias("score"))
        of = lambda where: detection.auroc(s.where(where).select("score", (F.col("label") <= 2).cast("int").alias("label")))  # noqa: B023, E731
        row = of("label <= 5").select(F.lit(f"e{k + 1}").alias("encoder"), F.col("auroc").alias("auroc_ar")).join(F.broadcast(of("label <= 2 OR label >= 6").select(F.col("auroc").alias("auroc_an"))))
        out = row if out is None else out.unionByName(row)
    return reports.rank_encoders(out).select("encoder", *r6("auroc_ar", "auroc_an"), "rank")


_KNOWN = [("view", "analog", True, "g1"), ("click", "analog", False, "g1"), ("purchase", "analog", True, "g2"), ("elsewhere", "digital", True, "g2")]


@query(f"""WITH {B.FINITE}, {B.FRAGMENTS}, k AS (SELECT * FROM (VALUES {", ".join(repr(r).replace("True", "true").replace("False", "false") for r in _KNOWN)}) t(channel, kind, target, grp)),
a AS (SELECT channel, round(avg(CAST(cnt > 0 AS INTEGER)), 6) AS finite_frac FROM panel GROUP BY 1), w AS (SELECT channel, count(*) AS n FROM finite GROUP BY 1),
l AS (SELECT Channel AS channel, count(DISTINCT ID) AS n_events, count(DISTINCT ID) FILTER (Category = 'Anomaly') AS n_anomaly, count(DISTINCT ID) FILTER (Category = 'Rare Event') AS n_rare FROM frag LEFT JOIN types USING (ID) WHERE EndTime < TIMESTAMP '{B.CUT}' GROUP BY 1)
SELECT channel, finite_frac, coalesce(n, 0) AS n_windows, coalesce(kind, '') AS kind, coalesce(target, false) AS target, coalesce(grp, '') AS "group", coalesce(n_events, 0) AS n_events, coalesce(n_anomaly, 0) AS n_anomaly, coalesce(n_rare, 0) AS n_rare,
  coalesce(kind, '') = 'analog' AND coalesce(target, false) AND channel NOT IN ('view') AND (coalesce(n_anomaly, 0) >= 3 OR coalesce(grp, '') IN ('g2')) AS candidate
FROM a LEFT JOIN w USING (channel) LEFT JOIN k USING (channel) LEFT JOIN l USING (channel)""")
def scout_channels(spark, d):
    labels = B.fragments(spark, d)
    stats = panel.window_report(B.grid(spark, d), W).select("channel", F.round("finite_frac", 6).alias("finite_frac"), "n_windows")
    known = spark.createDataFrame(_KNOWN, "channel string, kind string, target boolean, group string")
    rows = reports.scout(stats, known, events.label_counts(labels, B.types(labels), B.CUT))
    chosen = reports.candidates(rows, ["view"], ["g2"]).select("channel", F.lit(True).alias("c"))
    cols = ["channel", "finite_frac", "n_windows", "kind", "target", "group", "n_events", "n_anomaly", "n_rare"]
    return rows.join(chosen, "channel", "left").select(*cols, F.coalesce("c", F.lit(False)).alias("candidate"))
