"""Many logistic models in one plan: each pass over the rows gives the sums of every model.

A row says which models it trains (``models``, an array of small numbers), so it is
written and read once a pass however many models there are. A pass sums loss, gradient
and curvature of each model in the tasks; what comes together is one square of the width
for a model and a task, and the driver takes one damped Newton step for all models.
Nothing depends on the number of rows of a model, so none is bounded or sampled here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import shared

#: Models at once: their squares are on the driver together.
MOST = 4096


@dataclass
class Models:
    """Weights on standardised features; the last column is the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    counts: np.ndarray  # negatives and positives of each model

    def score(self, x: np.ndarray, m: int) -> np.ndarray:
        return (x - self.mean[m]) / self.scale[m] @ self.weights[m, :-1] + self.weights[m, -1]


def members(models: pd.Series, n: int) -> np.ndarray:
    """Rows by models: does the row take part?"""
    out = np.zeros((len(models), n), bool)
    size = models.map(len).to_numpy()
    if size.sum():
        out[np.repeat(np.arange(len(models)), size), np.concatenate(models.to_list()).astype(int)] = True
    return out


def sums(rows: DataFrame, width: int, work) -> np.ndarray:
    """What ``work`` gives for each batch (a matrix), added up over all rows."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                v = work(b)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"m": np.arange(len(total)), "v": list(total)})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": g.m.iloc[:1], "v": [np.sum(np.stack(g.v), axis=0)]})

    # One row of a model and a task: as many in a group as there are tasks.
    out = rows.mapInPandas(part, "m int, v array<double>").groupBy("m").applyInPandas(added, "m int, v array<double>").collect()
    return np.stack([np.array(r["v"]) for r in sorted(out, key=lambda r: r["m"])]) if out else np.zeros((0, width))


def fit(rows: DataFrame, n: int, l2: float = 1.0, balanced: bool = True, most: int = 40, tolerance: float = 1e-6) -> Models:
    """``n`` models from rows (models, label, f): least l2 / 2 of the squared weights and the sum of losses.

    ``balanced`` makes both classes of a model weigh the same. A model without rows of
    both classes is an error. Rows are read once for their moments and once a step.
    """
    if not 0 < n <= MOST:
        raise ValueError(f"1 to {MOST} models at once")
    rows = shared.written(rows.select("models", F.col("label").cast("double").alias("label"), "f"), "training")
    first = rows.select(F.size("f").alias("d")).limit(1).collect()
    d = first[0]["d"] if first else 0

    def moments(b: pd.DataFrame) -> np.ndarray:
        take, x, y = members(b.models, n).T.astype(float), np.stack(b.f).astype(float), b.label.to_numpy()
        return np.concatenate([take @ np.stack([1 - y, y], axis=1), take @ x, take @ x**2], axis=1)

    m = sums(rows, 2 + 2 * d, moments)
    if len(m) < n or (m[:, :2] < 1).any():
        raise ValueError("every model needs rows of both classes")
    count = m[:, :2].sum(axis=1, keepdims=True)
    mean = m[:, 2 : 2 + d] / count
    scale = np.sqrt(np.maximum(m[:, 2 + d :] / count - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    share = count / 2 / m[:, :2] if balanced else np.ones((n, 2))
    at, back, best = np.zeros((n, d + 1)), np.zeros((n, d + 1)), np.full(n, np.inf)
    live = np.arange(n)
    kept = at.copy()
    for _ in range(most):
        w, which = at.copy(), live.copy()

        def slopes(b: pd.DataFrame) -> np.ndarray:
            take, raw, y = members(b.models, n), np.stack(b.f).astype(float), b.label.to_numpy()
            out = np.zeros((len(which), 1 + (d + 1) + (d + 1) ** 2))
            for k, i in enumerate(which):
                own = take[:, i]
                x = np.concatenate([(raw[own] - mean[i]) / scale[i], np.ones((own.sum(), 1))], axis=1)
                z, t, c = x @ w[i], y[own], share[i][y[own].astype(int)]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                out[k, 0] = (c * (np.logaddexp(0, z) - t * z)).sum()
                out[k, 1 : d + 2] = (c * (p - t)) @ x
                out[k, d + 2 :] = ((x * (c * p * (1 - p))[:, None]).T @ x).ravel()
            return out

        found = sums(rows, 0, slopes)
        penalty = l2 * np.append(np.ones(d), 0.0)
        still = []
        for k, i in enumerate(live):
            loss = found[k, 0] + (penalty * at[i] ** 2).sum() / 2
            if loss > best[i] + 1e-12 * abs(best[i]):  # too far: half the way back
                at[i] = (at[i] + back[i]) / 2
                if np.abs(at[i] - back[i]).max() >= tolerance:
                    still.append(i)
                continue
            best[i], back[i] = loss, at[i].copy()
            kept[i] = at[i]
            slope = found[k, 1 : d + 2] + penalty * at[i]
            curve = found[k, d + 2 :].reshape(d + 1, d + 1) + np.diag(penalty + 1e-9)
            step = np.linalg.solve(curve, slope)
            at[i] = at[i] - step
            if np.abs(step).max() >= tolerance:
                still.append(i)
            else:
                kept[i] = at[i]
        live = np.array(still, int)
        if not len(live):
            break
    return Models(mean, scale, kept, m[:, :2])


def scored(rows: DataFrame, models: Models, *keep: str) -> DataFrame:
    """(model, score, keep...): a row for each model that the row lists in ``models``."""
    fields = [rows.select(*keep).schema[c] for c in keep]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            take = members(b.models, len(models.weights))
            x = np.stack(b.f).astype(float) if len(b) else np.zeros((0, models.mean.shape[1]))
            for i in np.flatnonzero(take.any(axis=0)):
                own = take[:, i]
                yield pd.DataFrame({"model": np.full(own.sum(), i, np.int32), "score": models.score(x[own], i)} | {c: b.loc[own, c] for c in keep})

    return rows.select("models", "f", *keep).mapInPandas(work, ", ".join(["model int", "score double", *[f"`{f.name}` {f.dataType.simpleString()}" for f in fields]]))
