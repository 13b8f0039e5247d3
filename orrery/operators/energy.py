"""Energies of embeddings against a reference set, and the nominal shell.

Queries meet references block by block; each pair of blocks gives partial sums of
exponentials and the nearest distances of a query, which are put together by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import ranking, shared
from orrery.operators import blocks

MOST = 20_000


def references(refs: DataFrame, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A reference set that a sampler carries to its tasks: at most ``MOST`` rows, by the caller's choice; more are an error."""
    rows = refs.select("x", F.col(kind).alias("kind") if kind else F.lit(0).alias("kind")).limit(MOST + 1).toPandas()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} references")
    x = np.stack(rows.x).astype(float) if len(rows) else np.zeros((0, 0))
    return x, rows.kind.to_numpy()


def log_sum_exp(x: np.ndarray, times: float = 1.0) -> np.ndarray:
    """Of each row of ``x`` times a factor; ``x`` is overwritten."""
    x *= times
    m = x.max(axis=1, keepdims=True)
    x -= m
    return m[:, 0] + np.log(np.exp(x, out=x).sum(axis=1))


def energies(queries: DataFrame, refs: DataFrame, tau: float, k: int = 8, kind: str | None = None) -> DataFrame:
    """(query_id, soft, nearest, knn, balanced) of queries (query_id, x); all infinite without references.

    soft: -tau log sum exp(-d2 / tau); knn: over the k nearest alone; balanced: kinds
    weigh the same, whatever their number of references.
    """
    own = refs.select("x", F.col(kind).cast("string").alias("kind") if kind else F.lit("").alias("kind"))

    def work(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            z = blocks.matrix(q.x)
            for name, part in r.groupby("kind", dropna=False):
                y, few = blocks.matrix(part.x), min(k, len(part))
                total, near = np.empty(len(z)), np.empty((len(z), few))
                for s in blocks.tiles(len(z), len(y)):
                    d2 = blocks.squares(z[s], y)
                    near[s] = np.sort(np.partition(d2, few - 1, axis=1)[:, :few], axis=1)
                    total[s] = log_sum_exp(d2, -1 / tau)
                out.append(pd.DataFrame({"query_id": q.query_id, "kind": name, "n": len(part), "part": total, "near": list(near)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "kind", "n", "part", "near")}, dtype=object)

    met = blocks.meet(queries.select("query_id", "x"), own, work, "query_id long, kind string, n long, part double, near array<double>")
    total = lambda a: F.aggregate(F.transform(a, lambda v: F.exp(v - F.array_max(a))), F.lit(0.0), lambda x, y: x + y)
    log_total = lambda a: F.array_max(a) + F.log(total(a))
    first = lambda a: F.slice(F.array_sort(F.flatten(a)), 1, k)
    # One row for a query, a kind and a block of references.
    per = met.groupBy("query_id", "kind").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts"), F.collect_list("near").alias("near"))
    per = per.select("query_id", "n", log_total(F.col("parts")).alias("part"), first(F.col("near")).alias("near"))
    all_ = per.groupBy("query_id").agg(F.collect_list("part").alias("parts"), F.collect_list(F.col("part") - F.log("n")).alias("means"), F.collect_list("near").alias("near"))
    all_ = all_.withColumn("near", first(F.col("near")))
    scored = all_.select(
        "query_id",
        (-tau * log_total(F.col("parts"))).alias("soft"),
        F.array_min("near").alias("nearest"),
        (-tau * log_total(F.transform("near", lambda v: -v / tau))).alias("knn"),
        (-tau * (log_total(F.col("means")) - F.log(F.size("means")))).alias("balanced"),
    )
    rows = queries.select("query_id").join(scored, "query_id", "left")
    return rows.select("query_id", *[F.coalesce(c, F.lit(float("inf"))).alias(c) for c in ("soft", "nearest", "knn", "balanced")])


#: Buckets of a pass over all pairs, and how many values of one bucket come out as rows.
CUTS, FEW = 4096, 1_000_000


def inside(d2: np.ndarray, path: list[tuple[float, float, int]]) -> np.ndarray:
    """Values that lie in bucket k of [low, high) at every level (low, high, k) of ``path``."""
    ok = np.ones(d2.shape, bool)
    for low, high, k in path:
        ok &= bucket(d2, low, high) == k
    return ok


def bucket(d2: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(np.floor((d2 - low) * (CUTS / (high - low))), 0, CUTS - 1).astype(np.int64)


def spread(rows: DataFrame) -> float:
    """No less than any squared distance of two rows: the diagonal of the box around them."""
    sides = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg((F.max("v") - F.min("v")).alias("s"))  # a row a coordinate
    return sides.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("d")).first()["d"]


def median_square(rows: DataFrame, few: int = FEW) -> float | None:
    """The squared distance at place floor((n - 1) / 2) of all pairs of rows; None of fewer than two.

    Passes over all pairs count them in ``CUTS`` buckets, each pass within the median's
    bucket of the one before, until it holds ``few`` pairs or one value; the last one gives
    the values of that bucket alone. What leaves a pair of blocks is never its pairs.
    """
    own, size = blocks.numbered(rows.select("x").withColumn("id", F.monotonically_increasing_id()), "pairs")
    if size < 2:
        return None
    n = size * (size - 1) // 2
    place, low, high = (n - 1) // 2, 0.0, spread(own)
    path: list[tuple[float, float, int]] = []
    while n > few and high > low:

        def counted(tiles: Iterator[np.ndarray], path=tuple(path), low=low, high=high) -> pd.DataFrame:
            c, least, most = np.zeros(CUTS, np.int64), np.full(CUTS, np.inf), np.full(CUTS, -np.inf)
            for d2 in tiles:
                d2 = d2[inside(d2, path)]
                k = bucket(d2, low, high)
                c += np.bincount(k, minlength=CUTS)
                np.minimum.at(least, k, d2)
                np.maximum.at(most, k, d2)
            k = np.flatnonzero(c)
            return pd.DataFrame({"k": k, "c": c[k], "low": least[k], "high": most[k]})

        # At most CUTS rows a pair of blocks; CUTS on the driver.
        passed = blocks.among(own, size, counted, "k long, c long, low double, high double")
        got = sorted(passed.groupBy("k").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")).collect(), key=lambda r: r["k"])
        for r in got:
            if place < r["c"]:
                break
            place -= r["c"]
        path.append((low, high, r["k"]))
        n, low, high = r["c"], r["low"], r["high"]
    if high == low:
        return float(low)

    def values(tiles: Iterator[np.ndarray]) -> pd.DataFrame:
        v, c = np.unique(np.concatenate([np.zeros(0), *(d2[inside(d2, path)] for d2 in tiles)]), return_counts=True)
        return pd.DataFrame({"d2": v, "c": c})

    few_values = blocks.among(own, size, values, "d2 double, c long")
    at = ranking.below(few_values.groupBy("d2").agg(F.sum("c").alias("c")), [], "d2", ["c"])
    return at.where(F.col("c_below") <= place).agg(F.max("d2").alias("d2")).first()["d2"]


def locality(rows: DataFrame, refs: DataFrame, basis: np.ndarray, centre: np.ndarray, tau: float, top: float = 0.1) -> DataFrame:
    """(query_id, share): how much of the squared gradient of the soft energy lies on the ``top`` share of a window's steps.

    ``rows`` (query_id, x) and ``refs`` (x) are windows; the encoder is linear, so the
    gradient is exact: 2 (z - mean of the references, weighted by nearness) on the basis.
    Blocks meet; a pair of blocks gives one weighted sum of references for a query. A
    gradient of zero has a share of zero; without references there are no rows.
    """

    def work(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({c: [] for c in ("query_id", "m", "s", "v")}, dtype=object)
        z, y = (blocks.matrix(q.x) - centre) @ basis, (blocks.matrix(r.x) - centre) @ basis
        m, total, v = np.empty(len(z)), np.empty(len(z)), np.empty(z.shape)
        for s in blocks.tiles(len(z), len(y)):
            w = blocks.squares(z[s], y) / -tau
            m[s] = w.max(axis=1)
            w -= m[s, None]
            p = np.exp(w, out=w)
            total[s], v[s] = p.sum(axis=1), p @ y
        return pd.DataFrame({"query_id": q.query_id, "m": m, "s": total, "v": list(v)})

    met = blocks.meet(rows.select("query_id", "x"), refs.select("x"), work, "query_id long, m double, s double, v array<double>")
    # One row for a query and a block of references.
    parts = met.groupBy("query_id").agg(F.collect_list(F.struct("m", "s", "v")).alias("p"))

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, p in zip(b.x, b.p, strict=True):
                m, s, v = np.array([e["m"] for e in p]), np.array([e["s"] for e in p]), np.stack([np.array(e["v"], float) for e in p])
                w = np.exp(m - m.max())
                g2 = (2 * ((np.array(x, float) - centre) @ basis - (w @ v) / (w @ s)) @ basis.T) ** 2
                k = max(1, round(top * len(g2)))
                out.append(np.sort(g2)[-k:].sum() / max(g2.sum(), 1e-12))
            yield pd.DataFrame({"query_id": b.query_id, "share": out})

    return rows.select("query_id", "x").join(parts, "query_id").mapInPandas(shares, "query_id long, share double")


def proto_energy(rows: DataFrame) -> DataFrame:
    """Squared distance of each row's x to its own prototype ``proto``."""
    from orrery.functions import arrays as A

    return rows.select("query_id", A.squared_distance(F.col("x"), F.col("proto")).alias("energy"))


def shell(refs: DataFrame, validation: DataFrame, q: float = 0.99, scale: float = 0.25, tau: float | None = None) -> DataFrame:
    """One row: tau (root of the lower median squared distance of references), Q_q, delta, mean and std of the energy."""
    if tau is None:
        # The lower middle of n values is the order statistic at floor((n - 1) / 2).
        mid = median_square(refs)
        tau = max(float(np.sqrt(mid)), 1e-3) if mid is not None else 1e-3
    h = energies(validation, refs, tau)
    p = ranking.quantiles(h, "soft", [0.25, 0.75, q])
    one = h.agg(F.avg("soft").alias("h_mean"), F.stddev_pop("soft").alias("h_std"))
    p = F.broadcast(p.select(F.col("q").alias("p")))
    return one.join(p).select(F.lit(tau).alias("tau"), F.col("p")[2].alias("q_value"), F.greatest(scale * F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-6)), F.lit(1e-4)).alias("delta"), "h_mean", "h_std")


def band_report(rows: DataFrame, q_value: Column | float, delta: Column | float, energy: str = "soft") -> DataFrame:
    """One row: where energies lie relative to the band around q_value."""
    h = F.col(energy)
    q, d = (v if isinstance(v, Column) else F.lit(v) for v in (q_value, delta))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(float("nan")))
    return rows.agg(F.count(h).alias("n"), F.coalesce(F.avg(h), F.lit(float("nan"))).alias("mean"), F.coalesce(F.stddev_pop(h), F.lit(float("nan"))).alias("std"), share(F.abs(h - q) <= d).alias("frac_in_band"), share(h < q - d).alias("frac_below"), share(h > q + d).alias("frac_above"))
