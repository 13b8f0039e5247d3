"""The model stage without a deep-learning library: Gaussian denoiser, linear encoder, their samplers.

Neural parity is out of reach here, and reports say so. Each channel has a Gaussian
of its windows (mean and covariance by summed moments), whose noise prediction is
closed-form; the encoder is a principal component analysis, so guidance gradients
are exact. Samplers run in Arrow batches with the models as closures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import hashing


@dataclass(frozen=True)
class Schedule:
    n_steps: int = 200
    start: float = 1e-4
    end: float = 0.02

    def alpha_bar(self) -> np.ndarray:
        return np.cumprod(1 - np.linspace(self.start, self.end, self.n_steps))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(t, beta, alpha_bar)."""
        beta = self.start + F.col("id") * ((self.end - self.start) / max(1, self.n_steps - 1))
        t = spark.range(self.n_steps).select(F.col("id").cast("int").alias("t"), beta.alias("beta"))
        arr = t.agg(F.array_sort(F.collect_list(F.struct("t", "beta"))).alias("b"))
        bar = F.transform("b", lambda r, i: F.aggregate(F.slice("b", 1, i + 1), F.lit(1.0), lambda a, v: a * (1 - v["beta"])))
        return arr.select(F.inline(F.zip_with("b", bar, lambda r, a: F.struct(r["t"].alias("t"), r["beta"].alias("beta"), a.alias("alpha_bar")))))


def time_embedding(t: Column, dim: int) -> Column:
    """Sines, then cosines, of t at geometric frequencies."""
    half = dim // 2
    freq = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.exp(-F.log(F.lit(10000.0)) * i / max(1, half - 1)))
    return F.concat(F.transform(freq, lambda f: F.sin(t * f)), F.transform(freq, lambda f: F.cos(t * f)))


def q_sample(rows: DataFrame, alpha_bar: float, seed: int = 0) -> DataFrame:
    """Forward noise at one level: sqrt(a) x + sqrt(1 - a) e with keyed Gaussians."""
    a = float(alpha_bar)
    return rows.withColumn("x", F.transform("x", lambda v, t: a**0.5 * v + (1 - a) ** 0.5 * hashing.gauss(seed, F.col("donor_id"), t)))


def timed(rows: DataFrame, schedule: Schedule, seed: int = 0) -> DataFrame:
    """Rows (donor_id, channel_idx, x) with a time t drawn by keyed hash, its level a, keyed noise e and the noised window xt."""
    bars = F.array(*[F.lit(float(b)) for b in schedule.alpha_bar()])
    at = rows.withColumn("t", hashing.pick(seed, schedule.n_steps, F.col("donor_id"), F.lit("time")).cast("int"))
    at = at.withColumns({"a": F.get(bars, F.col("t")), "e": F.transform("x", lambda _, i: hashing.gauss(seed, F.col("donor_id"), i))})
    return at.withColumn("xt", F.zip_with("x", "e", lambda v, e: F.sqrt("a") * v + F.sqrt(1 - F.col("a")) * e))


def error_by_time(errors: DataFrame, n_steps: int, n_bins: int = 8) -> DataFrame:
    """(lo, hi, n, mse) of rows (t, mse) in even buckets of time; buckets without rows have n 0 and mse 0."""
    edge = lambda b: F.floor(b * n_steps / n_bins).cast("int")
    b = F.least(F.floor(((F.col("t") + 1) * n_bins - 1) / n_steps), F.lit(n_bins - 1))
    got = errors.groupBy(b.cast("int").alias("b")).agg(F.count("*").alias("n"), F.avg("mse").alias("mse"))
    every = errors.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("b"))
    return every.join(got, "b", "left").select(edge(F.col("b")).alias("lo"), edge(F.col("b") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mse", F.lit(0.0)).alias("mse"))


def noise_error_apart(train: DataFrame, rows: DataFrame, schedule: Schedule | None = None, seed: int = 0, n_bins: int = 8, ridge: float = 1e-6) -> DataFrame:
    """Squared error of the noise that independent Gaussians of each channel and step predict, by buckets of time."""
    schedule = schedule or Schedule()
    per = train.select("channel_idx", F.posexplode("x").alias("i", "v")).groupBy("channel_idx", "i").agg(F.avg("v").alias("m"), (F.var_pop("v") + ridge).alias("s"))
    model = per.groupBy("channel_idx").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("g"))
    at = timed(rows, schedule, seed).join(F.broadcast(model), "channel_idx")  # a row a channel
    guess = F.zip_with("xt", "g", lambda v, g: F.sqrt(1 - F.col("a")) * (v - F.sqrt("a") * g["m"]) / (F.col("a") * g["s"] + 1 - F.col("a")))
    mse = F.aggregate(F.zip_with(guess, "e", lambda p, e: (p - e) * (p - e)), F.lit(0.0), lambda x, y: x + y) / F.size("x")
    return error_by_time(at.select("t", mse.alias("mse")), schedule.n_steps, n_bins)


def noise_error(model: Gaussians, rows: DataFrame, schedule: Schedule | None = None, seed: int = 0, n_bins: int = 8) -> DataFrame:
    """The same of the sampler's own model, with its covariances."""
    schedule = schedule or Schedule()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (c, a), g in b.groupby(["channel_idx", "a"]):
                e = model.noise(np.stack(g.xt).astype(float), int(c), float(a))
                yield pd.DataFrame({"t": g.t, "mse": ((e - np.stack(g.e).astype(float)) ** 2).mean(axis=1)})

    each = timed(rows, schedule, seed).select("channel_idx", "t", "a", "e", "xt").mapInPandas(work, "t int, mse double")
    return error_by_time(each, schedule.n_steps, n_bins)


@dataclass
class Gaussians:
    """Mean and covariance of the windows of each channel, in their eigenbasis."""

    mean: dict[int, np.ndarray]
    values: dict[int, np.ndarray]
    vectors: dict[int, np.ndarray]

    def noise(self, x: np.ndarray, c: int, a: float) -> np.ndarray:
        """Expected noise in rows x_t of channel c at level a."""
        v, u = self.values[c], self.vectors[c]
        r = (x - np.sqrt(a) * self.mean[c]) @ u
        return np.sqrt(1 - a) * (r / (a * v + 1 - a)) @ u.T


def fit_gaussians(train: DataFrame, ridge: float = 1e-6) -> Gaussians:
    """Sums and cross products are taken in tasks; the driver gets one matrix of window width for a channel."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, list] = {}
        for b in batches:
            for c, g in b.groupby("channel_idx"):
                x = np.stack(g.x).astype(float)
                s = acc.setdefault(int(c), [0, 0.0, 0.0])
                s[0] += len(x)
                s[1] = s[1] + x.sum(axis=0)
                s[2] = s[2] + x.T @ x
        for c, (n, s, m) in acc.items():
            yield pd.DataFrame({"channel_idx": [c], "n": [n], "s": [s], "m": [m.ravel()]})

    parts = train.select("channel_idx", "x").mapInPandas(work, "channel_idx int, n long, s array<double>, m array<double>")
    wide = parts.select("channel_idx", "n", F.posexplode(F.concat("s", "m")).alias("i", "v")).groupBy("channel_idx", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    rows = wide.groupBy("channel_idx").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).select("channel_idx", "n", F.col("v.v").alias("v")).collect()
    out = Gaussians({}, {}, {})
    for r in rows:
        v = np.array(r["v"])
        w = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
        mu = v[:w] / r["n"]
        cov = v[w:].reshape(w, w) / r["n"] - np.outer(mu, mu)
        values, vectors = np.linalg.eigh(cov + ridge * np.eye(w))
        c = r["channel_idx"]
        out.mean[c], out.values[c], out.vectors[c] = mu, np.maximum(values, ridge), vectors
    return out


@dataclass
class Guide:
    """A linear encoder, references in its space, and how to steer.

    mode ``band`` pulls the energy to q_value from both sides, ``push`` only up to it, ``off`` not at all.
    """

    basis: np.ndarray
    centre: np.ndarray
    refs: np.ndarray
    tau: float
    q_value: float
    lam: float = 0.3
    clip: float = 1.0
    mode: str = "band"
    parent: float = 0.0
    n_correct: int = 1
    anomalies: np.ndarray | None = None
    lam_anom: float = 0.0
    proto: bool = False

    def energy(self, x: np.ndarray, refs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Soft energy of rows, and its gradient."""
        z = (x - self.centre) @ self.basis
        diff = z[:, None, :] - (self.refs if refs is None else refs)[None]
        s = -(diff**2).sum(axis=2) / self.tau
        m = s.max(axis=1, keepdims=True)
        p = np.exp(s - m)
        total = p.sum(axis=1, keepdims=True)
        grad = 2 * ((p / total)[:, :, None] * diff).sum(axis=1)
        return -self.tau * (m + np.log(total))[:, 0], grad @ self.basis.T

    def towards(self, x: np.ndarray, chosen: np.ndarray | None) -> np.ndarray:
        """Gradient of the anomaly term: to one prototype a row, or to all softly."""
        if self.anomalies is None or not len(self.anomalies) or not self.lam_anom:
            return np.zeros_like(x)
        if self.proto:
            z = (x - self.centre) @ self.basis
            return 2 * self.lam_anom * (z - self.anomalies[chosen % len(self.anomalies)]) @ self.basis.T
        return self.lam_anom * self.energy(x, self.anomalies)[1]

    def step(self, x: np.ndarray, x0: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
        if self.mode == "off":
            return x
        for _ in range(self.n_correct):
            h, g = self.energy(x)
            gap = h - self.q_value
            if self.mode == "push":
                gap = np.minimum(gap, 0)
            g = 2 * gap[:, None] * g + 2 * self.parent * (x - x0) + self.towards(x, chosen)
            size = np.linalg.norm(g, axis=1, keepdims=True)
            x = x - self.lam * g * np.minimum(1, self.clip / np.maximum(size, 1e-12))
        return x


def fit_encoder(train: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Basis (width x dim) and centre of a principal component analysis."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector("x").alias("v"))
    model = PCA(k=dim, inputCol="v", outputCol="z").fit(rows)
    n = F.count("*")
    mean = train.select(F.posexplode("x").alias("t", "v")).groupBy("t").agg((F.sum("v") / n).alias("m")).orderBy("t").collect()
    return np.array(model.pc.toArray()), np.array([r["m"] for r in mean])


def ddim(rows: DataFrame, model: Gaussians, schedule: Schedule | None = None, nu: float = 1.0, steps: int = 20, seed: int = 0, guide: Guide | None = None) -> DataFrame:
    """Windows noised to a share nu of the schedule and denoised in deterministic steps, guided or not; donor_id stays."""
    bars = (schedule or Schedule()).alpha_bar()
    top = max(0, min(len(bars) - 1, round(nu * (len(bars) - 1))))
    times = np.unique(np.linspace(0, top, max(2, steps)).round().astype(int))[::-1]
    noised = q_sample(rows, float(bars[top]), seed).select("donor_id", "channel_idx", "x", F.col("parent"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, g in b.groupby("channel_idx"):
                x, x0 = np.stack(g.x).astype(float), np.stack(g.parent).astype(float)
                for i, t in enumerate(times):
                    a = bars[t]
                    e = model.noise(x, int(c), a)
                    clean = (x - np.sqrt(1 - a) * e) / np.sqrt(a)
                    if guide is not None:
                        clean = guide.step(clean, x0)
                    after = bars[times[i + 1]] if i + 1 < len(times) else 1.0
                    x = np.sqrt(after) * clean + np.sqrt(1 - after) * e
                yield pd.DataFrame({"donor_id": g.donor_id, "channel_idx": g.channel_idx, "x": list(x)})

    return noised.mapInPandas(work, "donor_id long, channel_idx int, x array<double>")


def ddim_recipes(rows: DataFrame, model: Gaussians, recipes: dict[str, Guide | None], schedule: Schedule | None = None, nu: float = 1.0, steps: int = 20, seed: int = 0) -> DataFrame:
    """(donor_id, channel_idx, recipe, x): one pass in which every donor (donor_id, channel_idx, x, parent, recipe) follows its own recipe.

    Whatever order or partition donors come in, a donor's window is the same, and donor_id
    tells whose it is: slices of recipes need not be put back in order. Prototypes are
    chosen by keyed hash of the donor. Donors of a recipe that is not there are left out;
    ``None`` is unguided. Recipes go with the tasks: references are bounded by
    :func:`orrery.operators.energy.references`.
    """
    bars = (schedule or Schedule()).alpha_bar()
    top = max(0, min(len(bars) - 1, round(nu * (len(bars) - 1))))
    times = np.unique(np.linspace(0, top, max(2, steps)).round().astype(int))[::-1]
    known = rows.where(F.col("recipe").isin(list(recipes)))
    noised = q_sample(known, float(bars[top]), seed).select("donor_id", "channel_idx", "recipe", "x", "parent", hashing.hashed(seed, F.col("donor_id"), F.lit("proto")).alias("chosen"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (c, name), g in b.groupby(["channel_idx", "recipe"]):
                guide, chosen = recipes[name], g.chosen.to_numpy()
                x, x0 = np.stack(g.x).astype(float), np.stack(g.parent).astype(float)
                for i, t in enumerate(times):
                    a = bars[t]
                    e = model.noise(x, int(c), a)
                    clean = (x - np.sqrt(1 - a) * e) / np.sqrt(a)
                    if guide is not None:
                        clean = guide.step(clean, x0, chosen)
                    after = bars[times[i + 1]] if i + 1 < len(times) else 1.0
                    x = np.sqrt(after) * clean + np.sqrt(1 - after) * e
                yield pd.DataFrame({"donor_id": g.donor_id, "channel_idx": g.channel_idx, "recipe": name, "x": list(x)})

    return noised.mapInPandas(work, "donor_id long, channel_idx int, recipe string, x array<double>")


def with_parent(rows: DataFrame) -> DataFrame:
    return rows.select("donor_id", "channel_idx", "x", F.col("x").alias("parent"))


def ppca_inflate(rows: DataFrame, model: Gaussians, psi: float = 2.0, latent: int = 8, seed: int = 0, patch: float | None = None) -> DataFrame:
    """Windows redrawn with their latent spread inflated by psi; psi 1 gives the window's own projection.

    A window's posterior in the probabilistic principal components has mean z and variance
    n s / (s + n) in each direction (s the direction's variance, n that of what is left
    out); inflation draws from psi squared times that variance, less the variance itself.
    With ``patch``, places that deviate little from the window (squared, against ``patch``
    times its range) keep the window's values; at psi 1 nothing is patched.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, g in b.groupby("channel_idx"):
                mu, v, u = model.mean[int(c)], model.values[int(c)], model.vectors[int(c)]
                order = np.argsort(v)[::-1]
                top, rest = order[:latent], order[latent:]
                left = float(v[rest].mean()) if len(rest) else 0.0
                x = np.stack(g.x).astype(float)
                z = (x - mu) @ u[:, top]
                spread = np.sqrt(max(psi * psi - 1, 0.0) * left * v[top] / (left + v[top]))
                noise = np.stack([np.random.default_rng([seed, int(d)]).standard_normal(len(top)) for d in g.donor_id])
                y = mu + (z + spread * noise) @ u[:, top].T
                if patch is not None and psi != 1:
                    span = np.maximum(x.max(axis=1) - x.min(axis=1), 1e-12)[:, None]
                    y = np.where((y - x) ** 2 > patch * span, y, x)
                yield pd.DataFrame({"donor_id": g.donor_id, "channel_idx": g.channel_idx, "x": list(y)})

    return rows.select("donor_id", "channel_idx", "x").mapInPandas(work, "donor_id long, channel_idx int, x array<double>")


def supcon_loss(z: np.ndarray, label: np.ndarray, temperature: float = 0.1) -> float:
    """Supervised contrastive loss of one bounded batch."""
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    log_p = s - (s.max(axis=1, keepdims=True) + np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)))
    same = (label[:, None] == label[None]) & ~np.eye(len(z), dtype=bool)
    n = same.sum(axis=1)
    each = np.where(same, np.where(same, log_p, 0), 0).sum(axis=1)[n > 0] / n[n > 0]
    return float(-each.mean()) if len(each) else 0.0

