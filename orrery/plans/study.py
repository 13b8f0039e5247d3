"""The detector study: arms, folds and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import ranking, shared
from orrery.operators import energy, inject, models, nearest, oof, scaling, selection, study, tuning
from orrery.plans import bindings as B
from orrery.plans.registry import query

W = B.WIDTH
GALLERIES = ("posthoc", "cutaddpaste", "taxonomy")
ARMS = (study.Arm("real_only", None, True), *[study.Arm(g, g, False) for g in GALLERIES], *[study.Arm(f"{g}_plus_real", g, True) for g in GALLERIES])
PLAN = study.Plan(ARMS, B.N_FOLDS, 5, 256, 512, B.SEED)


def _inputs(spark, d):
    """Labelled windows with their folds, nominal donors and three galleries made from them, in units of the channel's range."""
    s = B.scaler(spark, d)
    donors = B.donors(spark, d)
    made = {"posthoc": inject.posthoc(donors, W, B.SEED), "cutaddpaste": inject.cutaddpaste(donors, W, B.SEED), "taxonomy": inject.taxonomy(donors, W, B.SEED)}
    rows = None
    for name, g in made.items():
        one = scaling.span_normalise(g.select("donor_id", "channel_idx", "x"), s).select(F.lit(name).alias("method"), "donor_id", "x")
        rows = one if rows is None else rows.unionByName(one)
    real = B.kinded(spark, d).where("is_anomaly OR is_rare")
    real = scaling.span_normalise(real.select("event_id", "fold", F.when(F.col("is_anomaly"), "anomaly").otherwise("rare").alias("side"), F.col("kind_name").alias("kind"), "channel_idx", "x"), s)
    return real, scaling.span_normalise(donors.select("donor_id", "channel_idx", "x"), s), rows


@query()
def augmented_detector(spark, d):
    """A row for each of seven arms, three folds and five seeds."""
    scored, models = study.scores(PLAN, *_inputs(spark, d), W)
    r = study.report(PLAN, scored, models, 0.1)
    whole = ("arm", "fold", "seed", "n_pos", "n_neg", "n_nominal", "n_rare", "n_windows", "n_events")
    return r.select(*whole, *[F.round(c, 4).alias(c) for c in ("recall", "recall_boot", "recall_low", "recall_high", "window_recall", "far", "rare_far", "average_precision", "auroc")])


@query()
def augmented_summary(spark, d):
    """Recall of each arm over the seeds."""
    rows = study.summary(PLAN, study.scores(PLAN, *_inputs(spark, d), W)[0], 0.1)
    return rows.select("arm", *[F.round(c, 6).alias(c) for c in rows.columns if c != "arm"])


@query()
def oof_scores(spark, d):
    """Galleries of three variants for each fold, steered by the other folds' anomalies, against this fold's windows."""
    s = B.scaler(spark, d)
    unit = lambda df: scaling.transform(df, s, (-1.0, 1.0))
    train, donors = shared.written(unit(B.finite(spark, d)), "train"), shared.written(unit(B.donors(spark, d)).select("donor_id", "channel_idx", "x"), "donors")
    real = unit(B.kinded(spark, d).where("is_anomaly OR is_rare")).select(F.xxhash64("event_id", "channel", "start").alias("query_id"), F.col("event_id").cast("string").alias("event_id"), "fold", F.when(F.col("is_anomaly"), "anomaly").otherwise("rare").alias("side"), F.col("kind_name").alias("kind"), "x")
    real = shared.written(real, "queries")
    refs = shared.written(oof.references(real.where("side = 'anomaly'"), B.N_FOLDS, 64, B.SEED), "references")
    oof.assert_isolated(refs, real)
    basis, centre = models.fit_encoder(train, 4)
    z = oof.encoded(refs, basis, centre)
    quiet = (energy.references(donors.where(F.pmod("donor_id", F.lit(B.DONORS)) < 13))[0] - centre) @ basis
    base = models.Guide(basis, centre, quiet, 1.0, 1.0, 0.3)
    recipes = oof.variants(z, B.N_FOLDS, base, (B.KINDS[3], B.KINDS[1]), 1.0)
    rows = oof.allocated(donors, B.N_FOLDS, sorted({k for _, k in z}) or B.KINDS, B.SEED)
    made = shared.written(models.ddim_recipes(rows, models.fit_gaussians(train), recipes, nu=0.2, steps=20, seed=B.SEED), "made")
    r = oof.scores(real, made)
    return r.select("variant", "fold", "n_gallery", *[F.round(c, 4).alias(c) for c in ("tau", "coverage_anomaly", "arp_anomaly", "coverage_rare", "arp_rare", "gap")])


def _tuned(spark, d):
    """The report of all tuning cells on fold 0, and the median total variation of the real anomalies."""
    s = B.scaler(spark, d)
    unit = lambda df: scaling.transform(df, s, (-1.0, 1.0))
    train, donors = shared.written(unit(B.finite(spark, d)), "train"), shared.written(unit(B.donors(spark, d)).select("donor_id", "channel_idx", "x"), "donors")
    real = unit(B.kinded(spark, d).where("is_anomaly OR is_rare")).select(F.xxhash64("event_id", "channel", "start").alias("query_id"), F.col("event_id").cast("string").alias("event_id"), "fold", F.when(F.col("is_anomaly"), "anomaly").otherwise("rare").alias("side"), "x")
    real = shared.written(real, "queries")
    basis, centre = models.fit_encoder(train, 4)
    few = donors.where(F.pmod("donor_id", F.lit(B.DONORS)) < 13)
    shell = energy.shell(tuning.encode(few, basis, centre), shared.written(tuning.encode(donors, basis, centre), "encoded")).first()
    base = models.Guide(basis, centre, (energy.references(few)[0] - centre) @ basis, shell["tau"], shell["q_value"])
    tv = ranking.quantiles(real.where("side = 'anomaly'").select(A.total_variation(F.col("x")).alias("tv")), "tv", [0.5]).select(F.col("q")[0].alias("tv")).first()["tv"]
    return tuning.run(donors, real, models.fit_gaussians(train), base, shell["delta"], n_folds=B.N_FOLDS, seed=B.SEED), tv


@query()
def tuning_cells(spark, d):
    """Gates, occupancy and out-of-fold scores of 17 settings of the sampler."""
    rows = _tuned(spark, d)[0]
    return rows.select("cell", "family", "n", "finite", "explode", *[F.round(c, 4).alias(c) for c in ("occupancy", "h_mean", "h_std", "tv", "coverage_anomaly", "arp_anomaly", "coverage_rare", "arp_rare", "gap", "distance_anomaly", "distance_rare")])


@query()
def tuning_winners(spark, d):
    """Which cells win by occupancy, ARP and gap, and which a family recommends by total variation."""
    rows, tv = _tuned(spark, d)
    rows = shared.written(rows, "tuned")
    live = rows.where("NOT explode").select(F.col("cell").alias("id"), "family", "lam", "occupancy", F.col("arp_anomaly").alias("arp"), "tv")
    best = selection.recommend(live, tv, by="family").select(F.concat(F.lit("recommended_"), F.col("family")).alias("goal"), F.col("id").alias("cell"), F.round("excess", 4).alias("value"))
    return tuning.winners(rows).select("goal", "cell", F.round("value", 4).alias("value")).unionByName(best)


@query()
def gradient_locality(spark, d):
    """Share of the squared energy gradient on a tenth of the steps, by channel: windows of each channel against donors' windows."""
    s = B.scaler(spark, d)
    train = shared.written(scaling.transform(B.finite(spark, d), s, (-1.0, 1.0)), "train")
    rows = train.select((F.col("channel_idx").cast("long") * 1_000_000_000 + F.col("start")).alias("query_id"), "channel_idx", "x")
    refs = scaling.transform(B.donors(spark, d), s, (-1.0, 1.0))
    basis, centre = models.fit_encoder(train, 4)
    r = energy.locality(rows, refs, basis, centre, 1.0).join(rows.select("query_id", "channel_idx"), "query_id")
    return r.groupBy("channel_idx").agg(F.round(F.avg("share"), 4).alias("share"), F.count("*").alias("n_windows"))


_NE = f"""{B.DONOR}, {B.SCALER},
tr AS (SELECT f.channel_idx, i, 2 * (f.x[i + 1] - lo) / greatest(hi - lo, 1e-6) - 1 AS v FROM finite f JOIN scaler USING (channel_idx), (SELECT unnest(range(0, {W})) AS i)),
per AS (SELECT channel_idx, i, avg(v) AS m, var_pop(v) + 1e-6 AS s FROM tr GROUP BY 1, 2),
bars AS (SELECT t, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS a FROM (SELECT CAST(i AS INTEGER) AS t, 1e-4 + i * ((0.02 - 1e-4) / 199) AS beta FROM (SELECT unnest(generate_series(0, 199)) AS i))),
dt AS (SELECT donor_id, channel_idx, x, CAST({B.h(B.SEED, 'donor_id', "'time'")} % 200 AS INTEGER) AS t FROM donors),
lo AS (SELECT donor_id, d.channel_idx, t, a, i, 2 * (d.x[i + 1] - lo) / greatest(hi - lo, 1e-6) - 1 AS v,
  sqrt(-2 * ln(({B.h(B.SEED, 'donor_id', 'i', "'a'")} + 0.5) / 4294967296.0)) * cos(2 * pi() * (({B.h(B.SEED, 'donor_id', 'i', "'b'")} + 0.5) / 4294967296.0)) AS e
  FROM dt d JOIN scaler USING (channel_idx) JOIN bars USING (t), (SELECT unnest(range(0, {W})) AS i)),
er AS (SELECT donor_id, t, avg(pow(sqrt(1 - a) * (sqrt(a) * v + sqrt(1 - a) * e - sqrt(a) * m) / (a * s + 1 - a) - e, 2)) AS mse FROM lo JOIN per USING (channel_idx, i) GROUP BY 1, 2),
bk AS (SELECT b, b * 25 AS lo, (b + 1) * 25 AS hi FROM (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS b))"""


@query(f"WITH {_NE} SELECT lo, hi, count(t) AS n, round(coalesce(avg(mse), 0), 5) AS mse FROM bk LEFT JOIN er ON t >= lo AND t < hi GROUP BY 1, 2")
def noise_error_by_time(spark, d):
    s = B.scaler(spark, d)
    unit = lambda df: scaling.transform(df, s, (-1.0, 1.0))
    return models.noise_error_apart(unit(B.finite(spark, d)), unit(B.donors(spark, d)), seed=B.SEED).select("lo", "hi", "n", F.round("mse", 5).alias("mse"))


@query("SELECT query_id, round(min(d), 6) AS distance FROM (SELECT q.vec_id AS query_id, sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), lambda p: pow(p[1] - p[2], 2)))) AS d FROM embeddings q CROSS JOIN embeddings g WHERE q.label <= 5 AND g.label >= 6) GROUP BY 1")
def ring_nearest_distance(spark, d):
    """Nearest distances through pivots and rings, whatever the size of the gallery."""
    e = B.embedded(spark, d)
    return nearest.search(e.where("label <= 5"), e.where("label >= 6"), ring=256)[0].select("query_id", F.round("distance", 6).alias("distance"))
