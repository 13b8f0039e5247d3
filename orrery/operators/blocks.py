"""A stated set of queries against all rows of another table, block by block.

Both sides are dealt into blocks of bounded size, and each pair of blocks meets in one
group: neither side is ever whole on the driver, in a closure or in a task. Within a
group distances are taken in tiles of bounded size, so a task's memory is that of its two
blocks. Only what the groups make of their pairs moves on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import shared

#: The most rows of a block on either side.
LEFT, RIGHT = 16_384, 32_768
#: Blocks get smaller, down to ``LEAST`` rows, until about ``GROUPS`` pairs of them share the work.
LEAST, GROUPS = 1024, 96
#: Distances of a tile.
TILE = 4_000_000
#: Squared distances below this share of the rows' own squares are taken by differences: products would cancel.
CANCEL = 1e-3
#: Rows on either side of a tile in single precision: its products stay in a core's cache.
SIDE = 1024
#: With more rows a query than this that may be its nearest, a tile is taken by :func:`squares`.
MAY = 32


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` with a place ``_at``, and their number.

    The places are written with the rows: a task that runs again, or a second look at the
    plan, reads the same ones.
    """
    kept = shared.written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    return kept, kept.count()


def dealt(kept: DataFrame, n: int) -> DataFrame:
    """Places turned into the numbers of ``n`` blocks: by place, so repeated rows do not pile up."""
    return kept.withColumn("_at", F.pmod("_at", F.lit(n)).cast("int"))


def number(rows: int, others: int, most: int) -> int:
    """How many blocks of at most ``most`` rows, for a side of ``rows`` that meets ``others``."""
    even = int((rows * others / GROUPS) ** 0.5)
    return max(1, -(-rows // min(most, max(LEAST, even))))


def meet(left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """What ``work`` makes of every pair of blocks."""
    sizes = sizes or (LEFT, RIGHT)
    (left, rows), (right, others) = numbered(left, "left"), numbered(right, "right")
    n, m = number(rows, others, sizes[0]), number(others, rows, sizes[1])
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = dealt(left, n).withColumnRenamed("_at", "_l").withColumn("_r", every(m))
    b = dealt(right, m).withColumnRenamed("_at", "_r").withColumn("_l", every(n))
    return _grouped(a, b, n * m).applyInPandas(work, schema)


def among(kept: DataFrame, rows: int, work: Callable[[Iterator[np.ndarray]], pd.DataFrame], schema: str, most: int = LEFT) -> DataFrame:
    """What ``work`` makes, for every pair of blocks, of the squared distances of pairs of rows (id, x) with different ids, each once: an iterator of flat arrays.

    ``kept`` and ``rows`` come from :func:`numbered`.
    """
    n = number(rows, rows, most)
    at = dealt(kept, n)
    a = at.withColumnRenamed("_at", "_l").withColumn("_r", F.explode(F.sequence("_l", F.lit(n - 1))))
    # Columns under new names: both sides are one table.
    b = at.select(F.col("_at").alias("_r"), F.explode(F.sequence(F.lit(0), F.col("_at"))).alias("_l"), F.col("id").alias("j"), F.col("x").alias("y"))

    def pairs(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        def flat() -> Iterator[np.ndarray]:
            if len(p) and len(q):
                # In order of ids, so that passes see the same last digits.
                one, two = p.sort_values("id"), q.sort_values("j")
                x, y, i, j = matrix(one.x), matrix(two.y), one.id.to_numpy(), two.j.to_numpy()
                # A block meets itself in both orders of a pair.
                once = np.less if key[0] == key[1] else np.not_equal
                for s in tiles(len(x), len(y)):
                    yield squares(x[s], y)[once(i[s, None], j[None])]

        return work(flat())

    return _grouped(a, b, n * (n + 1) // 2).applyInPandas(pairs, schema)


def _grouped(a: DataFrame, b: DataFrame, groups: int):
    # A stated number of partitions: few bytes stand for much work, and would otherwise be put into one task.
    spread = lambda df: df.repartition(min(groups, 4096), "_l", "_r").groupBy("_l", "_r")
    return spread(a).cogroup(spread(b))


def tiles(n: int, m: int) -> Iterator[slice]:
    """Slices of n rows, each of which has a tile of bounded size with m others."""
    step = max(1, TILE // max(1, m))
    return (slice(i, i + step) for i in range(0, n, step))


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows by differences, in slices of bounded size: equal rows have equal ones."""
    out = np.empty((len(a), len(b)))
    step = max(1, TILE // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = ((a[i : i + step, None, :] - b[None]) ** 2).sum(axis=2)
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; callers take :func:`tiles`.

    By one product of centred matrices; where that would cancel, and for values that are
    not finite or overflow, by differences, so that every one is right to about 12 digits.
    """
    if not len(a) or not len(b):
        return np.empty((len(a), len(b)))
    with np.errstate(all="ignore"):
        c = b.mean(axis=0)
        p, q = a - c, b - c
        n, m = (p * p).sum(axis=1), (q * q).sum(axis=1)
        fits = np.isfinite(n.max() + m.max())
    if not fits:
        return differences(a, b)
    out = np.column_stack((-2 * p, n, np.ones(len(p)))) @ np.column_stack((q, np.ones(len(q)), m)).T
    near = np.flatnonzero(out.min(axis=1) <= CANCEL * (n + m.max()))
    i, j = np.nonzero(out[near] <= CANCEL * (n[near, None] + m))
    out[near[i], j] = apart(a, b, near[i], j)
    return out


def nearest(a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """The squared distance of each row to the nearest of ``b``; with ``most``, what is reached already, the smaller of both.

    Products of centred rows in single precision, with a bound on their error, say which
    rows may be the nearest; only these are taken by differences, so the result is as
    exact as theirs. A tile in which too many may be (copies, clusters far apart) is taken
    by :func:`squares`, and so is all that is not finite.
    """
    out = np.full(len(a), np.inf) if most is None else np.array(most, float)
    with np.errstate(all="ignore"):
        c = b.mean(axis=0)
        p, q = a - c, b - c
        n, m = (p * p).sum(axis=1), (q * q).sum(axis=1)
        top = max(n.max(), m.max())
    if not np.isfinite(top):
        return np.minimum(out, np.concatenate([squares(a[s], b).min(axis=1) for s in tiles(len(a), len(b))]))
    top = top or 1.0
    # Squared distances but for the rows' own squares, in units in which single precision overflows nowhere.
    n, m, root = n / top, m / top, np.sqrt(top)
    p, q = np.column_stack((-2 / root * p, np.ones(len(p)))).astype(np.float32), np.column_stack((q / root, m)).astype(np.float32)
    room = b.shape[1] + 8
    for s in range(0, len(a), SIDE):
        z, of = p[s : s + SIDE], n[s : s + SIDE]
        parts = [(slice(t, t + SIDE), m[t : t + SIDE].max()) for t in range(0, len(b), SIDE)]
        # Twice the bound of a product of so many terms, and of its parts' own rounding.
        error = [room * (2.0**-23 * (k + 2 * np.sqrt(of * k)) + 1e-37) + 1e-15 * of for _, k in parts]
        low = [(z @ q[t].T).min(axis=1) for t, _ in parts]
        upper = np.minimum(out[s : s + SIDE] / top - of, np.min([v + e for v, e in zip(low, error, strict=True)], axis=0))
        for (t, _), v, e in zip(parts, low, error, strict=True):
            k = np.flatnonzero(v - e <= upper)
            if not len(k):
                continue
            may = np.flatnonzero(z[k] @ q[t].T <= np.nextafter((upper + e)[k].astype(np.float32), np.float32(np.inf))[:, None])
            i, j = np.divmod(may, len(q[t]))
            k += s
            if len(may) > MAY * len(k):
                out[k] = np.minimum(out[k], squares(a[k], b[t]).min(axis=1))
            else:
                np.minimum.at(out, k[i], apart(a, b, k[i], j + t.start))
    return out


def apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of stated pairs of rows by differences, in slices of bounded size."""
    out = np.empty(len(i))
    step = max(1, TILE // max(1, b.shape[1]))
    for s in range(0, len(i), step):
        out[s : s + step] = ((a[i[s : s + step]] - b[j[s : s + step]]) ** 2).sum(axis=1)
    return out


def matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_list()).astype(float)
