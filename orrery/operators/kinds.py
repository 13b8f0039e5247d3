"""Kinds of anomalies: labels, ranks, references, examples and allocation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import arrays as A
from orrery.functions import hashing, ranking, shared
from orrery.operators import blocks

# Names of kinds, fixed values.
POINT_LOCAL, POINT_GLOBAL = "real ESA Point / Local", "real ESA Point / Global"
SUB_LOCAL, SUB_GLOBAL = "real ESA local subsequence", "real ESA global subsequence"
SHIFT, UNKNOWN = "real level shift", "real ESA unknown"
SPIKE, SUBTLE, MEDIUM, LONG = "real short spike", "real short subtle", "real medium event", "real long campaign"


def esa_kind(x: Column, length: Column, locality: Column, shift_cut: float = 0.01) -> Column:
    """Kind from length and locality, with global subsequences that shift their level apart."""
    leng, loc = (F.lower(F.coalesce(F.trim(c), F.lit(""))) for c in (length, locality))
    return (
        F.when(leng == "point", F.when(loc == "local", POINT_LOCAL).otherwise(POINT_GLOBAL))
        .when(leng == "subsequence", F.when(loc == "local", SUB_LOCAL).when(A.level_shift(x) >= shift_cut, SHIFT).otherwise(SUB_GLOBAL))
        .otherwise(UNKNOWN)
    )


def shape_kind(x: Column, span: Column, amp: float = 0.1, shift_cut: float = 0.01, short: int = 100, medium: int = 4000) -> Column:
    """The older names, from the labelled span and the window's shape."""
    return (
        F.when((span < short) & (A.amplitude(x) >= amp), SPIKE)
        .when(span < short, SUBTLE)
        .when(A.level_shift(x) >= shift_cut, SHIFT)
        .when(span < medium, MEDIUM)
        .otherwise(LONG)
    )


def kind_stat(x: Column, kind: Column) -> Column:
    """How much a window is like its kind."""
    return F.when(kind.contains("level shift"), A.level_shift(x)).when(kind.contains("subtle") | kind.contains("local subsequence"), -A.amplitude(x)).otherwise(A.amplitude(x))


def rank_for_kind(rows: DataFrame, n: int, ties: list[str]) -> DataFrame:
    """The ``n`` windows of each kind that are most like it, with their rank."""
    stat = rows.withColumn("stat", kind_stat(F.col("x"), F.col("kind_name")))
    order = Window.partitionBy("kind_name").orderBy(F.col("stat").desc(), *ties)
    return stat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def kind_refs(rows: DataFrame, fold: int, most: int, ties: list[str]) -> DataFrame:
    """References of each kind from other folds; a kind that has none takes all of its windows and is marked ``leaked``."""
    outside = rows.groupBy("kind_name").agg(F.count_if(F.col("fold") != fold).alias("n_oof"))
    marked = rows.join(outside, "kind_name").withColumn("leaked", F.col("n_oof") == 0)
    live = marked.where(F.col("leaked") | (F.col("fold") != fold))
    order = Window.partitionBy("kind_name").orderBy(*ties)
    return live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def kind_examples(rows: DataFrame, n: int, ties: list[str]) -> DataFrame:
    """``n`` typical windows of each kind: nearest to the median amplitude, of distinct events first."""
    amp = rows.withColumn("amp", A.amplitude(F.col("x")))
    middle = ranking.quantiles(shared.written(amp.select("kind_name", "amp"), "amplitudes"), "amp", [0.5], ["kind_name"]).select("kind_name", F.col("q")[0].alias("mid"))
    near = amp.join(middle, "kind_name").withColumn("off", F.round(F.abs(F.col("amp") - F.col("mid")), 9))
    own = F.row_number().over(Window.partitionBy("kind_name", "event_id").orderBy("off", *ties))
    first = near.withColumn("again", (own > 1).cast("int"))
    order = Window.partitionBy("kind_name").orderBy("again", "off", *ties)
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def alloc_contiguous(donors: DataFrame, kinds: list[str]) -> DataFrame:
    """Kinds in blocks of donors, the first blocks one larger where it does not divide."""
    spot = ranking.numbered(donors.withColumn("all", F.lit(0)), ["all"], ranking.number_bucket(donors, "donor_id"), ["donor_id"])
    tile = ranking.tile(F.col("index"), F.col("n"), len(kinds))
    return spot.withColumn("kind_alloc", F.element_at(F.array(*map(F.lit, kinds)), tile + 1)).drop("all", "index", "n")


def alloc_shares(donors: DataFrame, shares: list[tuple[str, float]]) -> DataFrame:
    """Recipes in blocks of donors by their shares, rounded half to even; the last one takes what is left."""
    spot = ranking.numbered(donors.withColumn("all", F.lit(0)), ["all"], ranking.number_bucket(donors, "donor_id"), ["donor_id"])
    rule, upto = None, F.lit(0)
    for recipe, share in shares[:-1]:
        upto = upto + F.bround(F.col("n") * share)
        rule = (F.when if rule is None else rule.when)(F.col("index") < upto, recipe)
    last = F.lit(shares[-1][0])
    return spot.withColumn("recipe", last if rule is None else rule.otherwise(last)).drop("all", "index", "n")


def alloc_stratified(donors: DataFrame, kinds: list[str], seed: int = 0) -> DataFrame:
    """Kinds even within each channel; which kinds get the remainder turns with the channel."""
    k = len(kinds)
    turns = donors.select("channel_idx").distinct().withColumn("turn", F.row_number().over(Window.orderBy("channel_idx")) - 1)  # one row for a channel
    h = donors.withColumn("h", hashing.hashed(seed, F.col("donor_id")))
    spot = ranking.numbered(h, ["channel_idx"], ranking.hash_bucket(F.col("h")), ["h", "donor_id"]).join(turns, "channel_idx")
    tile = ranking.tile(F.col("index"), F.col("n"), k)
    return spot.withColumn("kind_alloc", F.element_at(F.array(*map(F.lit, kinds)), ((tile + F.col("turn")) % k + 1).cast("int"))).drop("h", "index", "n", "turn")


def nearest_generated(queries: DataFrame, gallery: DataFrame, by: str = "kind_name") -> DataFrame:
    """Greedy one-to-one matches within each group: in order of query_id, each takes the nearest window that is left (the smallest donor_id of equals).

    A choice depends on all before it, but of k queries none can need more than its k
    nearest windows. Those are found block by block; what is left to one task is a group's
    k x k candidates. Queries are examples, few by the caller's choice.
    """
    most = queries.groupBy(by).agg(F.count("*").alias("k"))
    q = queries.select(by, F.col("query_id"), "x").join(most, by)
    g = gallery.select(by, "donor_id", "x").join(F.broadcast(most.select(by)), by, "left_semi")

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, part in a.groupby(by):
            there = b[b[by] == name]
            if len(there):
                d, ids = np.sqrt(blocks.differences(blocks.matrix(part.x), blocks.matrix(there.x))), there.donor_id.to_numpy()
                for i, row, k in zip(part.query_id, d, part.k, strict=True):
                    best = np.lexsort((ids, row))[:k]
                    out.append(pd.DataFrame({by: name, "query_id": i, "donor_id": ids[best], "distance": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({by: [], "query_id": [], "donor_id": [], "distance": []}, dtype=object)

    found = blocks.meet(q, g, near, f"{by} string, query_id long, donor_id long, distance double")
    order = Window.partitionBy(by, "query_id").orderBy("distance", "donor_id")
    live = found.join(most, by).withColumn("rank", F.row_number().over(order)).where("rank <= k")

    def match(p: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for i, rows in p.sort_values(["query_id", "rank"]).groupby("query_id"):
            left = rows[~rows.donor_id.isin(taken)]
            if len(left):
                taken.add(left.donor_id.iloc[0])
                out.append((p[by].iloc[0], i, left.donor_id.iloc[0], left.distance.iloc[0]))
        return pd.DataFrame(out, columns=[by, "query_id", "donor_id", "distance"])

    return live.select(by, "query_id", "donor_id", "distance", "rank").groupBy(by).applyInPandas(match, f"{by} string, query_id long, donor_id long, distance double")


def farthest_points(rows: DataFrame, n: int, rounds_id: str = "donor_id", pool: int = 4096) -> DataFrame:
    """Maximin sample: begin at the smallest id, then always the row farthest from those chosen (the smallest id of equals).

    Every row keeps its squared distance to the nearest chosen one, in a written table.
    A pass takes the ``pool`` rows with the largest to the driver and chooses among them
    as long as the best is beyond all rows outside: a distance only shrinks as rows are
    chosen, so none of those can be farther. Then one scan brings the table up to date.
    Each pass chooses one row at least; ``pool`` bounds the driver, not the result.
    Rows equal to a chosen one are never chosen, so fewer than ``n`` may come out; no
    rows give none. Rows without an id or with a null x are left out.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(rounds_id).alias("id"), "x").where("id IS NOT NULL AND x IS NOT NULL")
    live = own.withColumn("m", F.lit(float("inf")))
    first = live.orderBy("id").limit(1).collect()
    chosen = [r["id"] for r in first]
    new = [np.asarray(r["x"], float) for r in first]
    while new and len(chosen) < n:
        centres = np.stack(new)

        def nearer(batches: Iterator[pd.DataFrame], centres=centres) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x, m = np.stack(b.x).astype(float), b.m.to_numpy()
                    for c in centres:
                        m = np.minimum(m, ((x - c) ** 2).sum(axis=1))
                    yield b.assign(m=m)[m > 0]

        live = shared.written(live.mapInPandas(nearer, live.schema), "maximin")
        top = live.orderBy(F.desc("m"), "id").limit(pool + 1).collect()
        beyond = top[pool]["m"] if len(top) > pool else 0.0
        top, new = top[:pool], []
        ids, m = np.array([r["id"] for r in top]), np.array([r["m"] for r in top])
        x = np.stack([np.asarray(r["x"], float) for r in top]) if top else np.zeros((0, 0))
        while len(top) and len(chosen) < n:
            best = np.lexsort((ids, -m))[0]
            # At the start of a pass the first row is the best of all; later ties with rows outside need a new pass.
            if m[best] <= 0 or (new and m[best] <= beyond):
                break
            chosen.append(int(ids[best]))
            new.append(x[best])
            m = np.minimum(m, ((x - x[best]) ** 2).sum(axis=1))
    return spark.createDataFrame([(int(i), k) for k, i in enumerate(chosen[:n])], f"{rounds_id} long, rank int")
