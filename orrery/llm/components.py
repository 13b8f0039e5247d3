"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation of the smallest neighbour per node and a join back,
both over tables written in the shared folder. So the two sides of the join come
straight from their shuffles and Spark can split a node with very many edges; the
aggregation combines before its shuffle. Rounds grow with the logarithm of the
component sizes; no component is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One star step over edges (u, v) with u > v; the result has the same form."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
    rows = both.join(low.hint("merge"), "u")
    if large:  # every larger neighbour of u goes to u's smallest
        out = rows.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and every smaller neighbour go to the smallest
        out = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    done = scratch.cut(out.where(F.col("u") > F.col("v")).distinct(), "edges")
    scratch.drop(low)
    return done


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node reachable.

    ``edges`` has columns a and b of one orderable type. Self-edges, repeated
    edges and either direction are allowed; edges with a null end are ignored.
    """
    live = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = scratch.cut(live.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        after = _star(now, True, scratch)
        after2 = _star(after, False, scratch)
        same = _signature(now) == _signature(after2)
        scratch.drop(after)
        scratch.drop(now)
        now = after2
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return scratch.cut(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")


def _signature(edges: DataFrame) -> tuple:
    """Count and order-independent checksums of a set of edges."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1)))).first()
    return tuple(r)
