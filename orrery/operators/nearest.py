"""Exact nearest neighbours of a stated set of queries, without comparing all pairs.

Gallery rows lie in cells by their nearest pivot; blocks of queries meet blocks of the
gallery (:mod:`orrery.operators.blocks`), and in each pair of blocks the rows of a cell
lie in rings of bounded size by their distance from the pivot. For a query, a ring whose
distances from the pivot are [lo, hi] cannot hold anything nearer than the query's own
distance from the pivot is from that range (triangle inequality). Pivots are gallery
rows, so the nearest of them bounds the distance at first; the ring that promises most
tightens it; then only rings within the bound are compared. Nothing is lost: a ring is
skipped only if its best row cannot be nearer than one already found. Which ring a query
asks for never leaves the task, so where nothing can be ruled out (noise) the cost is
that of all pairs and the memory still that of two blocks; a query that the pivots leave
with most of a block meets it whole, as many small rings would cost more than they spare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import shared
from orrery.operators import blocks

#: Pivots of each group of the gallery: they go with the tasks.
PIVOTS = 256
#: Rows of a ring, and queries that meet it at once.
RING, QUERIES = 1024, 4096
#: Distances are compared with this much room, relative to their size, for rounding.
SLACK = 1e-9
#: A query that may find its nearest row in this share of a block or more meets the block without rings.
WHOLE = 0.5


def pivots(gallery: DataFrame, most: int) -> dict[str, np.ndarray]:
    """At most ``most`` different rows of each group (grp, x), by hash of the row: a bounded set."""
    order = Window.partitionBy("grp").orderBy("h")
    few = gallery.select("grp", "x", F.xxhash64("x").alias("h")).groupBy("grp", "h").agg(F.first("x").alias("x")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    rows = few.select("grp", "x").toPandas()
    return {g: np.stack(p.x).astype(float) for g, p in rows.groupby("grp")}


def celled(gallery: DataFrame, points: dict[str, np.ndarray]) -> DataFrame:
    """(grp, x, cell, r): the nearest pivot of each row and the distance r from it."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("grp"):
                d = blocks.squares(blocks.matrix(part.x), points[g])
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"grp": g, "x": part.x, "cell": cell, "r": np.sqrt(d[np.arange(len(d)), cell])})

    return gallery.select("grp", "x").mapInPandas(near, "grp string, x array<double>, cell int, r double")


def within(q: np.ndarray, y: np.ndarray, cell: np.ndarray, r: np.ndarray, points: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, compared) of each query: to the nearest of ``y`` or of the pivots, and with how many rows it was compared."""
    order = np.lexsort((r, cell))
    y, cell, r = y[order], cell[order], r[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    place = np.arange(len(cell)) - np.repeat(first, np.diff(np.r_[first, len(cell)]))
    start = np.flatnonzero(place % ring == 0)
    end = np.r_[start[1:], len(cell)]
    lo, hi, of, size = r[start][:, None], r[end - 1][:, None], cell[start], end - start
    best, compared = np.empty(len(q)), np.zeros(len(q), np.int64)
    for s in range(0, len(q), QUERIES):
        z = q[s : s + QUERIES]
        at = np.sqrt(blocks.squares(z, points)).T
        near, n = at.min(axis=0), compared[s : s + QUERIES]
        at = at[of]
        low = np.maximum(np.maximum(at - hi, lo - at), 0.0)
        whole = size @ (low <= near + SLACK * (near + at)) >= WHOLE * len(y)

        def look(rows: slice, i: np.ndarray, z=z, near=near, n=n) -> None:
            if len(i):
                some = z if len(i) == len(z) else z[i]
                near[i] = np.sqrt(blocks.nearest(some, y[rows], near[i] ** 2))
                n[i] += rows.stop - rows.start

        look(slice(0, len(y)), np.flatnonzero(whole))
        promising = np.where(whole, -1, low.argmin(axis=0))
        for k in np.unique(promising[~whole]):
            look(slice(start[k], end[k]), np.flatnonzero(promising == k))
        if not whole.all():
            for k in range(len(start)):
                look(slice(start[k], end[k]), np.flatnonzero((low[k] <= near + SLACK * (near + at[k])) & (promising != k) & ~whole))
        best[s : s + QUERIES] = near
    return best, compared


def search(queries: DataFrame, gallery: DataFrame, by: str | None = None, most: int = PIVOTS, ring: int = RING) -> tuple[DataFrame, DataFrame]:
    """((query_id, grp, distance), (grp, pairs, compared)): nearest distances, and how many pairs there are and were compared."""
    own = gallery.select((F.col(by).cast("string") if by else F.lit("")).alias("grp"), F.col("x").cast("array<double>").alias("x")).where("grp IS NOT NULL")
    own = shared.written(own, "gallery")
    # More cells than rings would only be more groups.
    points = pivots(own, min(most, max(1, -(-2 * own.count() // ring))))
    spark = queries.sparkSession
    if not points:
        return spark.createDataFrame([], "query_id long, grp string, distance double"), spark.createDataFrame([], "grp string, pairs long, compared long")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("x").cast("array<double>").alias("x"))

    def work(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({c: [] for c in ("query_id", "grp", "d", "n")}, dtype=object)
        z, out = blocks.matrix(q.x), []
        for k, p in g.groupby("grp"):
            d, n = within(z, blocks.matrix(p.x), p.cell.to_numpy(), p.r.to_numpy(), points[k], ring)
            out.append(pd.DataFrame({"query_id": q.query_id, "grp": k, "d": d, "n": n}))
        return pd.concat(out)

    met = blocks.meet(asked, celled(own, points), work, "query_id long, grp string, d double, n long")
    out = met.groupBy("query_id", "grp").agg(F.min("d").alias("distance"))
    sizes = own.groupBy("grp").agg(F.count("*").alias("g"))  # a row a group
    used = met.groupBy("grp").agg(F.sum("n").alias("compared")).join(F.broadcast(asked.agg(F.count("*").alias("q"))))
    return out, used.join(F.broadcast(sizes), "grp").select("grp", (F.col("q") * F.col("g")).alias("pairs"), "compared")


def direct(queries: DataFrame, gallery: DataFrame, by: str | None = None) -> DataFrame:
    """(query_id, grp, distance) of a gallery that is one block: queries meet it as they are."""
    own = gallery.select((F.col(by).cast("string") if by else F.lit("")).alias("grp"), F.col("x").cast("array<double>").alias("x")).where("grp IS NOT NULL")

    def work(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({c: [] for c in ("query_id", "grp", "d2")}, dtype=object)
        z = blocks.matrix(q.x)
        return pd.concat([pd.DataFrame({"query_id": q.query_id, "grp": k, "d2": blocks.nearest(z, blocks.matrix(p.x))}) for k, p in g.groupby("grp")])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("x").cast("array<double>").alias("x"))
    met = blocks.meet(asked, own, work, "query_id long, grp string, d2 double")
    return met.groupBy("query_id", "grp").agg(F.sqrt(F.min("d2")).alias("distance"))


def distances(queries: DataFrame, gallery: DataFrame, by: str | None = None, most: int = PIVOTS) -> DataFrame:
    """(query_id, [by,] distance) to the nearest gallery row; no row for a query without any. A gallery of more than one block is searched by rings."""
    small = gallery.limit(blocks.RIGHT + 1).count() <= blocks.RIGHT
    out = direct(queries, gallery, by) if small else search(queries, gallery, by, most)[0]
    return out.select("query_id", F.col("grp").cast(gallery.schema[by].dataType).alias(by), "distance") if by else out.select("query_id", "distance")
