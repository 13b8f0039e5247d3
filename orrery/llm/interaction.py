"""Filter interaction audit: what each filter removes in every order of the filters.

Each document is reduced to one mask of failed filters, and documents to *cells*: for a
part (a language) and a mask, how many documents, how many of them good, how many
toxic. A part has at most 2 ** filters cells, whatever its size, so all that follows is
independent of the corpus. The orders are then visited by adjacent transpositions: each
differs from the one before by a swap of two neighbours, so only the two steps of the
swap are computed again from the cells. The Shapley sum of a filter is accumulated along
the walk, from the removals of its step in each order.

The table-wide filter E (an identical text with a smaller id) takes the smallest id of
each text's SHA-256, aggregated before the shuffle. It is joined back on digest and id
together, so a text that a third of all rows share is spread over all tasks by its ids;
equal rows are one row with a count by then. No text is shuffled.

Defined cases: a null text is an empty text (and a copy of other empty ones); a null
part is the empty string; a row with a null id has no label, fails no E and makes no
other row fail it; rows with one id and one text are no copies of each other; several
labels of one id count as good (toxic) if any is; labels of no document do not count.
Very long texts are read whole. An empty table has no parts and gives no rows. Columns
other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Scratch, let, words

#: Every order is visited: 8 filters have 40,320 of them for each part.
MOST = 8


@dataclass(frozen=True)
class Filter:
    letter: str
    fails: str | None  # SQL over the measurements; None: a text identical to that of a smaller id


FILTERS = (
    Filter("A", "n_words < 200"),
    Filter("B", "100 * n_distinct < 50 * n_words"),
    Filter("C", "100 * n_upper > 3 * n_chars"),
    Filter("D", "has_symbol"),
    Filter("E", None),
)


def measured(text: Column) -> Column:
    """Struct of n_words, n_distinct, n_upper, n_chars and has_symbol."""
    t = F.coalesce(text, F.lit(""))
    count = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))
    return F.struct(let(words(text), count).alias("w"), F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"), F.char_length(t).cast("long").alias("n_chars"), t.rlike(r"[#$%&*|]").alias("has_symbol"))


def masks(docs: DataFrame, filters: tuple[Filter, ...], id_col: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, digest, mask, n): one row for equal documents; ``mask`` without the filter of identical texts."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), measured(F.col(text)).alias("m"))
    flat = own.select("doc_id", "part", "digest", "m.w.n_words", "m.w.n_distinct", "m.n_upper", "m.n_chars", "m.has_symbol")
    bits = [F.when(F.expr(f.fails), 1 << i).otherwise(0) for i, f in enumerate(filters) if f.fails]
    return flat.groupBy("doc_id", "part", "digest", sum(bits, F.lit(0)).cast("int").alias("mask")).agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; bit i of the mask is filter i."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.cut(masks(docs, filters, id_col, text, part), "masks")
    first = own.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = sum((1 << i for i, f in enumerate(filters) if f.fails is None), 0)
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    whole = scratch.cut(own.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", "n", (F.col("mask") + F.when(later, copy).otherwise(0)).alias("mask")), "masks")
    marked = labels.groupBy(F.col("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    # An inner join: rows without a label, null ids among them, never meet in one task.
    seen = whole.join(marked, "doc_id").select("part", "mask", F.lit(0).cast("long").alias("n"), (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    zero = F.lit(0).cast("long")
    return whole.select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")).unionByName(seen).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def transpositions(n: int) -> Iterator[int]:
    """The left place of each adjacent swap that leads from 0..n-1 through all its orders, each once."""
    place, step = list(range(n)), [-1] * n  # the place of each element and the way it looks
    while True:
        at = {p: e for e, p in enumerate(place)}
        movable = [e for e in range(n) if (o := at.get(place[e] + step[e])) is not None and o < e]
        if not movable:
            return
        e = max(movable)
        other = at[place[e] + step[e]]
        yield min(place[e], place[other])
        place[e], place[other] = place[other], place[e]
        for k in range(e + 1, n):
            step[k] = -step[k]


def walk(table: np.ndarray, letters: str) -> list[tuple]:
    """Rows (filter_order, step, letter's index, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.

    ``table`` has n, good and toxic of every mask.
    """
    size = len(letters)
    mask = np.arange(1 << size)
    total = int(table[:, 0].sum())
    has = [mask >> f & 1 == 1 for f in range(size)]
    fails = [int(table[h, 0].sum()) for h in has]
    alone = [int(table[1 << f, 0]) for f in range(size)]
    order, steps, shapley, out = list(range(size)), [None] * size, [0] * size, []

    def step(i: int) -> None:
        before = sum(1 << f for f in order[:i])
        gone = table[has[order[i]] & (mask & before == 0)].sum(axis=0)
        steps[i] = tuple(map(int, gone))

    def visit() -> None:
        kept, name = total, "".join(letters[f] for f in order)
        for i, f in enumerate(order):
            n, good, toxic = steps[i]
            kept -= n
            shapley[f] += n
            out.append((name, i + 1, f, kept, n, fails[f] - n, alone[f], good, toxic))

    for i in range(size):
        step(i)
    visit()
    for i in transpositions(size):
        order[i], order[i + 1] = order[i + 1], order[i]
        step(i)
        step(i + 1)
        visit()
    return [(*row, shapley[row[2]]) for row in out]


OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order and step. ``labels`` has doc_id, quality and toxic."""
    if not 0 < len(filters) <= MOST or len({f.letter for f in filters}) < len(filters) or any(len(f.letter) != 1 for f in filters):
        raise ValueError(f"an audit takes 1 to {MOST} filters of different letters ({factorial(MOST)} orders)")
    letters = "".join(f.letter for f in filters)

    def orders(group: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((1 << len(letters), 3), np.int64)
        table[group["mask"].to_numpy()] = group[["n", "good", "toxic"]].to_numpy()
        rows = pd.DataFrame(walk(table, letters), columns=["filter_order", "step", "filter", *OUT]).drop(columns="filter")
        rows.insert(0, "part", group["part"].iloc[0])
        return rows

    # At most 2 ** filters rows of a part: a bounded group.
    return cells(docs, labels, filters, id_col, text, part).groupBy("part").applyInPandas(orders, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUT))
