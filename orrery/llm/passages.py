"""Removal of word passages that occur elsewhere, by compaction of a de Bruijn graph.

Edges are windows of ``WIDTH`` words, nodes the ``WIDTH - 1`` words that two windows in a
row share. Only edges that occur twice or more are in the graph.

1. Windows are dealt out in runs: windows in a row whose smallest hash of ``GRAM`` words is
   the same one (a minimizer). A run is one row with a digest of its words, about one for 12
   words; equal windows have equal minimizers, so a minimizer that occurs once has no
   repeated edge and leaves after one count.
2. Runs that occur twice are repeated paths as they are. Runs that occur once but share a
   minimizer with others are looked at edge by edge, an edge being its two nodes: one that
   also lies on a repeated path is a place on it, other repeated edges are paths of one edge.
3. Paths compact: where one path ends and another begins at a node with no other way in or
   out, and the second follows the first in the first one's source, they are one. Pointer
   doubling by joins: as many rounds as the longest chain has binary digits. Links go
   forward in one document, so there are no cycles.
4. Every occurrence becomes a span of a compacted path, with its place on it. A compacted
   path is one stretch of one source document, so source coordinates verify it: spans are
   cut into cells of ``CELL`` words, and the words of every distinct piece are compared
   with those of the source in its cell. Until here edges were told apart by hashes (128
   bits); a piece that differs ends the query with an error rather than with lost or false
   words.

Documents and runs are numbered as their table is written, so what shuffles is numbers.
Rows are of bounded size; spans are gathered by document, whose words bound them.
Hot runs (copies of a passage in a third of all documents) are counted before the shuffle,
pieces are made distinct before it, and joins are inner ones that Spark can split.

Defined cases: null and empty texts have no words; texts under ``WIDTH`` words lose
nothing; windows never cross texts; repeated rows are copies of each other (with one id
and one text they share one result); very long texts are windowed in chunks; null ids are
fine. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.anchors import grams
from orrery.llm.common import Scratch

WIDTH = 35
GRAM = 8
CELL = 256
_REACH = WIDTH - GRAM + 1
_CHUNK = 1 << 22
_SLICE = 256
_MEMO = 500_000
#: An odd number and its inverse modulo 2 ** 64.
_BASE = (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Tokens(dict):
    """The 64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self) > _MEMO:
            self.clear()
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _SLICE):
            yield b.slice(at, _SLICE)


def _words(column: pa.Array) -> list[list[bytes]]:
    """bytes.split() cuts at space and U+0009 to U+000D."""
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


def minimizers(tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, hash): runs of window starts of the joined texts (of ``lens`` words), in order; no window crosses a text."""
    ends = np.repeat(np.cumsum(lens), lens)
    parts = []
    for base in range(0, max(len(tokens) - WIDTH + 1, 0), _CHUNK):
        h = grams(tokens[base : base + _CHUNK + WIDTH - 1], GRAM)
        low = np.uint64((1 << 23) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < _REACH:
            step = min(have, _REACH - have)
            m = np.minimum(m[: len(m) - step], m[step:])
            have += step
        at = (m & low).astype(np.int64)
        start = np.arange(len(at)) + base
        own = start + WIDTH <= ends[start]
        start, at = start[own], at[own]
        if len(start):
            # Windows of two texts lie WIDTH starts apart, so a gap tells them apart.
            new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
            parts.append((start[new], np.diff(np.append(new, len(start))), h[at[new]]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))  # type: ignore[return-value]


def digests(tokens: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the words of each run, wherever it stands: differences of running sums of a polynomial."""
    powers, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(tokens), k, np.uint64)))) for k in _BASE)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * powers[:-1])))
    return (upto[first + size + WIDTH - 1] - upto[first]) * back[first]


def runs(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, th, first, size, h, c): runs of ``size`` windows from word ``first`` of rows (doc, doc_id, th, text).

    ``h`` is their minimizer and ``c`` digests their words; doc_id and th stand in the first run of a document alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for b in _sliced(batches):
            texts = _words(b.column(3))
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            tokens = memo.of(texts)
            first, size, h = minimizers(tokens, lens)
            if not len(first):
                continue
            begin = np.cumsum(lens) - lens
            row = np.searchsorted(np.cumsum(lens), first, side="right")
            once = pa.array(row, mask=np.concatenate(([False], row[1:] == row[:-1])))
            cols = (first - begin[row]).astype(np.int32), size.astype(np.int32), h.view(np.int64), digests(tokens, first, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(once), b.column(2).take(once), *map(pa.array, cols)], ["doc", "doc_id", "th", "first", "size", "h", "c"])

    return docs.mapInArrow(work, f"doc long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, first int, size int, h long, c long")


def ways(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run, doc, first, size, n, head, tail, nodes) of wanted runs (doc_id, th, run, doc, first, size, n, edges): the first and the last node and, if ``edges``, all."""
    per = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th")).agg(F.collect_list(F.struct("run", "doc", "first", "size", "n", "edges")).alias("runs"))
    rows = docs.join(per, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("text", "runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Tokens()
        for b in _sliced(batches):
            lists = b.column(1)
            r = pa.RecordBatch.from_struct_array(lists.flatten())
            texts = _words(b.column(0))
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            each = np.repeat(np.cumsum(lens) - lens, np.diff(lists.offsets.to_numpy()))
            node = grams(memo.of(texts), WIDTH - 1, 11).view(np.int64)
            at, size = each + r["first"].to_numpy(), r["size"].to_numpy().astype(np.int64)
            wide = np.where(r["edges"].to_numpy(zero_copy_only=False), size + 1, 0)
            ends = np.cumsum(wide)
            flat = np.repeat(at - (ends - wide), wide) + np.arange(ends[-1] if len(ends) else 0)
            nodes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(node[flat]))
            yield pa.RecordBatch.from_arrays([r["run"], r["doc"], r["first"], r["size"], r["n"], pa.array(node[at]), pa.array(node[at + size]), nodes], ["run", "doc", "first", "size", "n", "head", "tail", "nodes"])

    return rows.mapInArrow(work, "run long, doc long, first int, size int, n long, head long, tail long, nodes array<long>")


def compacted(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """(p, u, base, s_doc, s_at): each path (p, doc, first, size, head, tail) as a stretch, ``base`` edges on, of the compacted path u, which starts at word s_at of its source."""
    place = F.struct("p", "doc", "first", "size")
    only = lambda node: paths.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("ways"), F.min(place).alias(node)).where("ways = 1").select("node", node)
    met = only("tail").join(only("head"), "node").where("head.doc = tail.doc AND head.first = tail.first + tail.size")
    now = scratch.cut(met.select(F.col("head.p").alias("p"), F.col("tail.p").alias("u"), F.col("tail.size").alias("base"), F.lit(True).alias("more")), "links")
    while now.where("more").limit(1).count():
        other = now.select(F.col("p").alias("u"), F.col("u").alias("v"), F.col("base").alias("on"), F.col("more").alias("on_more"))
        step = now.where("more").join(other, "u", "left")
        far = step.select("p", F.coalesce("v", "u").alias("u"), (F.col("base") + F.coalesce("on", F.lit(0))).alias("base"), F.coalesce("on_more", F.lit(False)).alias("more"))
        before, now = now, scratch.cut(now.where("NOT more").unionByName(far), "links")
        scratch.drop(before)
    base = F.coalesce("base", F.lit(0))
    return scratch.cut(paths.join(now, "p", "left").select("p", F.coalesce("u", "p").alias("u"), base.alias("base"), F.col("doc").alias("s_doc"), (F.col("first") - base).alias("s_at")), "paths")


def occurrences(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc, first, size, u, off, own): windows from word ``first`` that lie ``off`` edges on in the compacted path u, ``own`` in its source; and (doc, doc_id, th)."""
    every = scratch.cut(runs(docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "th", "text")).withColumn("run", F.monotonically_increasing_id()), "runs")
    # Counts are written first: a join straight from two shuffles lets Spark split a minimizer or a run that very many texts share.
    buckets = scratch.cut(every.groupBy("h").agg(F.count("*").alias("m"), (F.min("c") != F.max("c")).alias("mixed")).where("m > 1").select("h", "mixed"), "buckets")
    shared = scratch.cut(every.select("run", "doc", "first", "size", "h", "c").join(buckets, "h"), "shared")
    names = scratch.cut(every.where("th IS NOT NULL").select("doc", "doc_id", "th"), "names")
    scratch.drop(every)
    scratch.sweep()
    equal = scratch.cut(shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min("run").alias("rep")), "equal")
    known = scratch.cut(shared.join(equal, ["h", "c"]).select("run", "doc", "first", "size", "mixed", "n", "rep"), "known")
    scratch.drop(shared)
    scratch.sweep()
    wanted = known.where("run = rep").join(names, "doc").select("doc_id", "th", "run", "doc", "first", "size", "n", F.col("mixed").alias("edges"))
    near = scratch.cut(ways(docs, wanted), "ways")
    scratch.sweep()
    # Edges of mixed minimizers: on a repeated path, or in two or more runs that occur once.
    lone = 1 << 60
    spot = F.col("run") * 32 + F.col("i") + F.when(F.col("n") == 1, lone).otherwise(0)
    nodes = near.where("size(nodes) > 0").select("run", "n", "nodes", F.explode(F.sequence(F.lit(0), F.size("nodes") - 2)).alias("i"))
    edges = nodes.select(F.get("nodes", F.col("i")).alias("head"), F.get("nodes", F.col("i") + 1).alias("tail"), "n", spot.alias("spot"))
    repeated = scratch.cut(edges.groupBy("head", "tail").agg(F.sum("n").alias("n"), F.min("spot").alias("o")).where("n > 1").select("head", "tail", "o"), "repeated")
    single = scratch.cut(edges.where("n = 1").join(repeated, ["head", "tail"]).select("head", "tail", F.col("spot") - lone, "o").toDF("head", "tail", "spot", "o"), "single")
    scratch.sweep()
    at = lambda c: (F.floor(F.col(c) / 32).cast("long"), (F.col(c) % 32).cast("int"))
    run, i = at("spot")
    found = single.select("head", "tail", "spot", "o", run.alias("run"), i.alias("i")).join(near.where("n = 1").select("run", "doc", "first"), "run").select("head", "tail", "spot", "o", "doc", (F.col("first") + F.col("i")).alias("first"), F.lit(1).alias("size"))
    found = scratch.cut(found, "found")
    ones = found.where(F.col("spot") + lone == F.col("o")).select(F.col("o").alias("p"), "doc", "first", "size", "head", "tail")
    full = near.where("n > 1").select((F.col("run") * 32).alias("p"), "doc", "first", "size", "head", "tail").distinct()  # rows with one id and one text give theirs twice
    paths = compacted(scratch.cut(full.unionByName(ones), "segments"), scratch)
    scratch.drop(near)
    run, i = at("o")
    inside = F.col("o") < lone
    places = found.select("doc", "first", "size", F.when(inside, run * 32).otherwise(F.col("o")).alias("p"), F.when(inside, i).otherwise(0).alias("i"))
    whole = known.where("n > 1").select("doc", "first", "size", (F.col("rep") * 32).alias("p"), F.lit(0).alias("i"))
    own = (F.col("doc") == F.col("s_doc")) & (F.col("first") - F.col("off") == F.col("s_at"))
    spans = whole.unionByName(places).join(paths, "p").withColumn("off", F.col("base") + F.col("i"))
    return spans.select("doc", "first", "size", "u", "off", own.alias("own")), names


def merged(spans: list[dict]) -> list[tuple]:
    """(first, size, u, off, own): spans of one text; those that go on in the text and on the path become one."""
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s["u"], s["first"] - s["off"], s["first"])):
        key = (s["u"], s["first"] - s["off"])
        if out and out[-1][0] == key and out[-1][1] + out[-1][2] >= s["first"]:
            out[-1] = (key, out[-1][1], max(out[-1][2], s["first"] + s["size"] - out[-1][1]), s["own"])
        else:
            out.append((key, s["first"], s["size"], s["own"]))
    return [(first, size, u, first - diagonal, own) for (u, diagonal), first, size, own in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space), spans.

    ``spans`` holds (first, n_words, path, at): the long passage of a compacted path, from its word ``at``, that stands at word ``first``.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    found, names = occurrences(own, scratch)
    # Rows with one id and one text have the same spans: those of one of them do.
    once = names.groupBy("doc_id", "th").agg(F.min("doc").alias("doc"))
    each = found.groupBy("doc").agg(F.collect_list(F.struct("first", "size", "u", "off", "own")).alias("spans"))
    per = scratch.cut(each.join(once, "doc"), "spans").select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "spans")
    scratch.sweep()
    rows = own.join(per, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("doc_id", "text", "spans")
    columns = ("doc_id", "n_words", "n_removed", "kept", "spans", "cells")
    span = pa.struct([("first", pa.int64()), ("n_words", pa.int64()), ("path", pa.int64()), ("at", pa.int64())])
    cell = pa.struct([("u", pa.int64()), ("cell", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("words", pa.string()), ("own", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            out: list[tuple] = []
            for w, found in zip(_words(b.column(1)), b.column(2).to_pylist(), strict=True):
                gone, spans, cells = np.zeros(len(w), bool), [], []
                for first, size, u, off, mine in merged(found or []):
                    n = size + WIDTH - 1
                    gone[first : first + n] = True
                    spans.append((first, n, u, off))
                    at = off
                    while at < off + n:
                        end = min((at // CELL + 1) * CELL, off + n)
                        cells.append((u, at // CELL, at % CELL, end - at, b" ".join(w[first + at - off : first + end - off]).decode(), mine))
                        at = end
                kept = b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(w)
                out.append((len(w), int(gone.sum()), kept.decode(), [dict(zip(span.names, s, strict=True)) for s in sorted(spans)], [dict(zip(cell.names, c, strict=True)) for c in cells]))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.list_(cell)), strict=True))], columns)

    kinds = "n_words long, n_removed long, kept string, spans array<struct<first long, n_words long, path long, at long>>, cells array<struct<u long, cell long, lo int, n int, words string, own boolean>>"
    done = scratch.cut(rows.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {kinds}"), "done")
    verify(done)
    return done.drop("cells")


def verify(done: DataFrame) -> None:
    """Compare the words of every distinct piece with those of its path's source; an error where they differ."""
    pieces = done.select(F.explode("cells").alias("c")).select("c.*").groupBy("u", "cell", "lo", "n", "words").agg(F.max("own").alias("own"))
    source = pieces.where("own").select("u", "cell", F.col("lo").alias("s_lo"), F.col("n").alias("s_n"), F.col("words").alias("source"))
    other = pieces.where("NOT own").join(source, ["u", "cell"], "left")
    inside = F.array_join(F.slice(F.split("source", " "), F.col("lo") - F.col("s_lo") + 1, F.col("n")), " ")
    same = (F.col("s_lo") <= F.col("lo")) & (F.col("lo") + F.col("n") <= F.col("s_lo") + F.col("s_n")) & (F.col("words") == inside)
    if other.where(~F.coalesce(same, F.lit(False))).limit(1).count():
        raise RuntimeError("two different passages have equal hashes: nothing was removed")
