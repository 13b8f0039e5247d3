"""Benchmark decontamination by a prefix-filtered set join, in native operators only.

A record is one window of a benchmark item: ten consecutive words, or the whole
item if it has fewer. Its set of tokens are its five-word shingles (or itself, if
shorter), each with its place in the window. A document contains the window only
if it has all of its shingles, in particular the rarest: with containment 1 the
necessary prefix is one shingle. So

1. document shingles are matched with benchmark shingles by hash; each match
   keeps the few words around it (a bounded slice) and the words left before
   and after it. This table is the only thing gathered from the documents;
2. shingles are ordered by how often they occur over all documents, and each
   window keeps its rarest as prefix;
3. matches join prefixes on the shingle; the place of the shingle in the window
   gives the only place where the window can start, which has to lie in the
   document (positional bound) with enough words after it (length bound);
4. the words at that place are compared with the window's, exactly.

The benchmark side is broadcast after a count, and only below ``BROADCAST_ROWS``
shingles; above, hashes and places of the documents' shingles shuffle to the same join,
and the words around a match are fetched from the documents that have any. A window is
one row however many items share it: items join by window at the very end, as pairs of
a document and an item. Spark splits a shingle or window with very many matches
(adaptive skew join); hits are distinct (row, place) pairs, so copies of a passage in
one text cost one row each.

Defined cases: null or empty texts have no words and no windows; an item occurring
as several rows counts once (its windows all count); a null item id counts as an item,
but is not in the list; repeated documents each get
their row; document ids may be null or repeated, as rows are told apart by id and
text hash. Empty tables give empty results or zero counts. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Scratch, ascii_lower, let

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 2_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def windows(bench: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(win, item, words): the windows of each item, named by a digest of their words; ``item`` wraps the id, which may be null."""
    own = bench.select(F.struct(F.col(item_id).alias("id")).alias("item"), item_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    rows = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("words"))
    return rows.select(F.md5(F.array_join("words", " ")).alias("win"), "item", "words").distinct()


def shingles(wins: DataFrame) -> DataFrame:
    """(win, words, h, at, size): each shingle of each window, its place (0-based) and its length."""
    size = F.least(F.lit(SHINGLE), F.size("words"))
    at = F.sequence(F.lit(0), F.size("words") - size)
    part = wins.select("win", "words", F.posexplode(F.transform(at, lambda i: F.xxhash64(F.slice("words", i + 1, size)))).alias("at", "h"))
    return part.withColumn("size", F.least(F.lit(SHINGLE), F.size("words")))


def matches(docs: DataFrame, keys: DataFrame, small: bool, sizes: list[int]) -> DataFrame:
    """(doc_id, th, h, pos, near, before, after): where a benchmark shingle occurs in a document.

    ``near`` holds the words that a window around the shingle can span.
    """
    back = WINDOW - SHINGLE
    near = F.slice("w", F.greatest(F.lit(1), F.col("pos") + 1 - back), F.lit(2 * back + SHINGLE))
    place = [near.alias("near"), F.least(F.col("pos"), F.lit(back)).alias("before"), (F.size("w") - F.col("pos")).alias("after")]
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), item_words(F.col("text")).alias("w"))

    def of(size: int) -> DataFrame:
        """A flat array of hashes goes through the generator; the words stay in their row until a hash has matched."""
        grams = let(F.col("w"), lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (size - 1)), lambda i: F.xxhash64(F.slice(ws, i, size))))
        rows = own.where(F.size("w") >= size).select("doc_id", "th", "w", F.posexplode(grams).alias("pos", "h"))
        if small:
            return rows.join(F.broadcast(keys), "h").select("doc_id", "th", "h", "pos", *place)
        hit = rows.select("doc_id", "th", "h", "pos").join(keys, "h").distinct().select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "h", "pos")
        return own.join(hit, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th"))).select("doc_id", "th", "h", "pos", *place)

    return reduce(DataFrame.unionByName, map(of, sizes or [SHINGLE]))


def hits(docs: DataFrame, bench: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, start, len, win): every place where a benchmark window occurs; and (win, item, words). ``docs`` has doc_id and text."""
    named = scratch.cut(windows(bench), "windows")
    wins = scratch.cut(shingles(named.select("win", "words").distinct()), "shingles")
    keys = wins.select("h").distinct()
    # At most five values: the shingle length, and the lengths of shorter items.
    sizes = sorted(r["size"] for r in wins.select("size").distinct().collect())
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = scratch.cut(matches(docs, keys, small, sizes), "matches")
    often = found.groupBy("h").agg(F.count("*").alias("n"))
    rarity = wins.join(often, "h", "left")
    prefix = rarity.groupBy("win").agg(F.min_by(F.struct("words", "h", "at", F.col("n").alias("n")), F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("h"), F.col("at"))).alias("p"))
    prefix = prefix.where("p.n > 0").select("win", "p.words", "p.h", "p.at")
    pairs = found.join(prefix, "h")
    bound = (F.col("pos") >= F.col("at")) & (F.col("after") + F.col("at") >= F.size("words"))
    same = F.slice("near", F.col("before") - F.col("at") + 1, F.size("words")) == F.col("words")
    fits = F.col("before") >= F.col("at")
    return pairs.where(bound & fits).where(same).select("doc_id", "th", (F.col("pos") - F.col("at")).alias("start"), F.size("words").alias("len"), "win"), named


def by_document(found: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, th, n_hit, items): words inside any occurrence, and the items that occur."""
    per = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    which = found.select("doc_id", "th", "win").distinct().join(named.select("win", "item"), "win").select("doc_id", "th", "item").distinct()
    items = which.groupBy(F.col("doc_id").alias("i_id"), F.col("th").alias("i_th")).agg(F.collect_list("item").alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["start"] + s["len"]).alias("end")),
        lambda a: a["n"],
    )
    both = per.join(items, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("th") == F.col("i_th")))
    return both.select("doc_id", "th", covered.cast("long").alias("n_hit"), "items")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    places, named = hits(own, bench.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), scratch)
    found = scratch.cut(by_document(scratch.cut(places, "places"), named), "hits")
    rows = own.select("doc_id", F.xxhash64("text").alias("th"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    f = found.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "n_hit", "items")
    items = F.coalesce(F.array_sort(F.filter(F.transform("items", lambda x: x["id"].cast("string")), lambda x: x.isNotNull())), F.array().cast("array<string>"))
    return rows.join(f, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), items.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    bad = scratch.cut(hits(own, bench.select("item_id", "text"), scratch)[0].select("doc_id", "th").distinct(), "contaminated")
    b = bad.select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(id_col).alias("i"), F.xxhash64(F.col(text)).alias("h"))
    return rows.join(b, F.col("i").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_th")), "left_anti").select("d.*")
