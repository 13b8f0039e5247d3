"""Importance resampling towards a target distribution, over hashed word n-grams.

Words become integers by a dictionary, runs of words tuples of integers; the bytes of each
distinct tuple are put together and hashed once, and the counts of the tuples are joined
back to the documents that hold them. This happens block by block of documents (``BLOCK``
bytes of text, a dictionary of at most ``MEMO`` words): a dictionary of the whole corpus
would shuffle every word of it, and a tuple is hashed once for each block that holds it
instead. What leaves a block is bounded by its text, and what leaves a task for the sums
of the corpus is one count a bucket.

1. One pass over the texts writes the buckets of every document and the task's sums.
2. The sums of documents and target give one gain for each of ``BUCKETS`` buckets, the only
   thing that reaches the driver.
3. A pass over the buckets gives weights; a keyed Gumbel number is added, and the highest
   scores are drawn. Scores are whole numbers, so their counts (at most some 100,000
   different ones, as gains and noise are bounded) give each score the place where it
   begins; only equal scores are sorted by id. No task sorts the corpus.

Defined cases: a null or empty text has no words, no features and a weight of 0, and is
never drawn; a null id is keyed as the empty string and comes last among equal scores;
equal scores of equal ids are taken by features, then weight; repeated rows each count and
are each drawn or not; an empty target has counts of zero; an empty table gives no rows.
Very long texts are whole: a text longer than a block is a block. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import Scratch

BUCKETS = 10_000  # at most 32,767
LONGEST = 2
BLOCK = 8 << 20
MEMO = 500_000
SEED, LEAST, SHARE = 7, 20, 25

_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
#: A-Z lower-cased; everything that is in no word becomes a blank.
_TABLE = bytes(c if c in _WORD else 32 for c in bytes(range(256)).lower())


class Dictionary(dict):
    """The integer of each word, and the word of each integer."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.words)
        self.words.append(word)
        return i

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def features(texts: list[bytes | None], known: Dictionary, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_words, n_features, buckets): of each text, and the buckets of all texts' features, text by text."""
    words = [(t or b"").translate(_TABLE).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    ids = known.ids([w for ws in words for w in ws])
    row = np.repeat(np.arange(len(texts)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(ids))  # words from here to the end of the text
    name, grams = ids, None
    owner, found = [], []
    for size in range(1, longest + 1):
        if size > 1:
            # A run is the pair of the run without its last word (by its number) and that word.
            name, more = name[:-1] if len(name) else name, ids[size - 1 :]
            pair = name[: len(more)] << 32 | more
            fits = left[: len(pair)] >= size
        else:
            pair, fits = ids, left >= 1
        distinct, back = np.unique(pair, return_inverse=True)
        if size == 1:
            new = [known.words[i] for i in distinct.tolist()]
        else:
            new = [grams[p >> 32] + b" " + known.words[p & 0xFFFFFFFF] for p in distinct.tolist()]
        hashed = np.fromiter((crc32(g) % buckets for g in new), np.int64, len(new))
        owner.append(row[: len(pair)][fits])
        found.append(hashed[back][fits])
        name, grams = back, new
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner * buckets + found)  # sorted within a text, to take less room
    return n, np.bincount(owner, minlength=len(texts)), found[order]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in slices of at most BLOCK bytes, or one text."""
    for b in batches:
        ends = np.cumsum(np.fromiter((x or 0 for x in pc.binary_length(b.column(1)).to_pylist()), np.int64, b.num_rows))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
            yield b.slice(at, to - at)
            at = to


def bucketed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, sums) of rows (doc_id, text): a row each, and one row of ``sums`` a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "buckets", "sums"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, like = Dictionary(), np.zeros(buckets, np.int64), None
        for b in _blocks(batches):
            if len(known) > MEMO:
                known = Dictionary()
            like = b.column(0).type
            n, k, found = features(b.column(1).cast(pa.binary()).to_pylist(), known, longest, buckets)
            sums += np.bincount(found, minlength=buckets)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(k))).astype(np.int32)), pa.array(found.astype(np.int16)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(k), lists, pa.nulls(b.num_rows, pa.list_(pa.int64()))], names)
        if like is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, like), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int16())), pa.array([sums], pa.list_(pa.int64()))], names)

    return docs.mapInArrow(work, f"doc_id {kind}, n_words long, n_features long, buckets array<short>, sums array<long>")


def counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features in each bucket, a bounded array."""
    out = np.zeros(buckets, np.int64)
    for r in rows.where("sums IS NOT NULL").select(F.posexplode("sums").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier the target is to use a bucket), both with one count more in each."""
    n, m, k = float(docs.sum() + len(docs)), float(target.sum() + len(target)), len(docs)
    return np.fromiter((math.floor(1000 * math.log((float(t) + 1) * n / ((float(s) + 1) * m))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)), np.int64, k)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features (0 of none)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ends = np.concatenate(([0], np.cumsum(b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))))
            upto = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])))
            total, n = upto[ends[1:]] - upto[ends[:-1]], np.diff(ends)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    each = rows.where("sums IS NULL").select("doc_id", "n_words", "n_features", "buckets")
    return each.mapInArrow(work, f"doc_id {kind}, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` with ``score``: the weight and a Gumbel number keyed by seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, ... of the drawn ``share`` percent, by score, then id; null of the others."""
    whole = Window.partitionBy()  # one row for a score
    able = F.col("n_words") >= least
    sizes = rows.where(able).groupBy("score").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sizes.select("score", base.alias("base"), F.expr(f"{int(share)} * sum(n) OVER () DIV 100").alias("drawn"))
    inside = Window.partitionBy("score", "able").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    placed = rows.withColumn("able", able).join(tops, "score", "left").withColumn("at", F.col("base") + F.row_number().over(inside))
    rank = F.when(F.col("able") & (F.col("at") <= F.col("drawn")), F.col("at")).cast("long")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = SEED, least: int = LEAST, share: int = SHARE, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    if not 0 < buckets < 1 << 15 or longest < 1:
        raise ValueError("1 to 32,767 buckets, and runs of at least one word")
    scratch = Scratch(docs.sparkSession)
    own = scratch.cut(bucketed(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")), longest, buckets), "features")
    goal = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).cast("string").alias("text")), longest, buckets)
    gain = gains(counts(own, buckets), counts(goal, buckets))
    return ranked(scored(scratch.cut(weighted(own, gain), "weights"), seed), least, share)
