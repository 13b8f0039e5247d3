"""Removal of byte strings that occur elsewhere, by suffix order and longest previous factors.

The longest previous factor of a suffix is its longest match with one that begins
earlier in the corpus. It stands at the previous or the next smaller position in suffix
order, and its length is the least common prefix on the way there. A suffix whose
factor has ``WIDTH`` bytes or more is a later copy; one that has only such neighbours
after it is a first copy.

One suffix array of the corpus would be one sort of every byte. Instead the
suffixes are dealt out by a winnowed anchor: the smallest 32-byte gram among the
first 200 bytes. Suffixes that share 200 bytes have equal anchors at equal offsets, so
each bucket of anchors has a suffix array of its own, and

1. anchors that occur once (nearly all) leave after one count;
2. runs of suffixes around an anchor that are equal throughout (by anchor and digest,
   two 64-bit hashes) are counted; the first of them stands for all;
3. only different runs with one anchor are compared: their bytes are fetched, and put in
   suffix order in numpy, many buckets a batch: ranks of 8, 16 ... 128 bytes by prefix
   doubling, common prefixes from the ranks, smaller positions by pointer jumping.
   Suffixes are ordered by ``WIDTH`` bytes, equal ones by place. A bucket with more
   than ``CROWD`` different runs is not gathered: its suffixes become rows, which
   Spark groups by two 64-bit hashes of their ``WIDTH`` bytes.

Every table that is reused is written to the shared folder. Sizes: one anchor for
about 70 bytes in (1), the repeated ones in (2), the edges of copies in (3).

Defined cases: null and empty texts have no bytes; texts under ``WIDTH`` bytes
lose nothing; matches never cross texts; repeated rows are copies of each other
like any others (with one id and one text they share one result: all of it goes
if it is long enough); very long texts are winnowed in chunks. Null ids are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.anchors import WIDTH, grams, winnow
from orrery.llm.common import Scratch

CROWD = 2_000
_SLICE = 256


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = _SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first, size, h, c): runs of suffixes around each anchor of rows (doc_id, th, text).

    ``size`` counts suffix starts from ``first``; ``c`` digests the run's bytes and its anchor's place.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in _sliced(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            row, cols, cs = [], [], []
            for i, t in enumerate(texts):
                if t is None or len(t) < WIDTH:
                    continue
                first, last, at, h = winnow(np.frombuffer(t, np.uint8))
                row.append(np.full(len(first), i, np.int64))
                cols.append((first, last - first + 1, h))
                cs += [digest(t[x : y + WIDTH], z - x) for x, y, z in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)]
            if not row:
                continue
            first, size, h = (np.concatenate([c[k] for c in cols]) for k in range(3))
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.array(cs, np.uint64).view(np.int64))], ["doc_id", "th", "first", "size", "h", "c"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, first int, size int, h long, c long")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, th, h, n, first, bytes): the bytes of wanted runs (doc_id, th, h, n, first, size)."""
    per = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "n", "first", "size")).alias("runs")).select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "runs")
    rows = docs.join(per, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("doc_id", "th", "text", "runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            texts, each = b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()
            row = [i for i, rs in enumerate(each) for _ in rs]
            flat = [r for rs in each for r in rs]
            raw = [texts[i][r["first"] : r["first"] + r["size"] - 1 + WIDTH] for i, r in zip(row, flat, strict=True)]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([r["h"] for r in flat], pa.int64()), pa.array([r["n"] for r in flat], pa.int64()), pa.array([r["first"] for r in flat], pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "th", "h", "n", "first", "bytes"])

    return rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, h long, n long, first int, bytes binary")


def _starts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, owner, offset, at): every suffix of at least WIDTH bytes of the runs, in their order, and where it begins in the joined bytes."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    counts = lens - WIDTH + 1
    owner = np.repeat(np.arange(len(raw)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data, owner, offset, offset + np.repeat(np.cumsum(lens) - lens, counts)


def ranks(data: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """For 8, 16, 32 ... bytes up to ``width``: the rank of the string of that length at every place (zeros follow the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(data)]
    out, have = {8: np.unique(word, return_inverse=True)[1].astype(np.uint64)}, 8
    while 2 * have <= width:
        r = out[have]
        after = np.zeros_like(r)
        after[: max(len(r) - have, 0)] = r[have:]
        have *= 2
        out[have] = np.unique((r << np.uint64(32)) | after, return_inverse=True)[1].astype(np.uint64)
    return out


def suffix_array(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes of each bucket by their first ``width`` bytes, equal ones as given, and what each shares with the one before (up to ``width``)."""
    level = ranks(data, width)
    top = max(level)
    order = np.lexsort(((level[top][at] << np.uint64(32)) | level[top][at + width - top], bucket))
    i, j = at[order[1:]], at[order[:-1]]
    n = np.zeros(len(i), np.int64)
    for size in sorted(level, reverse=True):
        fits = n + size <= width
        step = np.minimum(n, width - size)
        n += size * (fits & (level[size][i + step] == level[size][j + step]))
    for _ in range(7):
        fits = n < width
        step = np.minimum(n, width - 1)
        n += fits & (data[i + step] == data[j + step])
    n[bucket[order[1:]] != bucket[order[:-1]]] = 0
    return order, np.concatenate(([0], n)) if len(order) else n


def match_before(order: np.ndarray, lcp: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each place in suffix order: what it shares with the previous smaller position, as far as that is ``width`` or more (else less)."""
    to, m = np.arange(len(order)) - 1, lcp.copy()
    live = np.flatnonzero((m >= width) & (order[to] > order))
    while len(live):
        via = to[live]
        m[live] = np.minimum(m[live], m[via])
        to[live] = to[via]
        live = live[(m[live] >= width) & (order[to[live]] > order[live])]
    return m


def previous_factors(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(has an earlier match, has any match) of ``width`` bytes in the bucket, of suffixes given in corpus order."""
    earlier, any_ = np.zeros(len(at), bool), np.zeros(len(at), bool)
    if not len(at):
        return earlier, any_
    order, lcp = suffix_array(data, at, bucket, width)
    after = np.concatenate((lcp[1:], [0]))
    factor = np.maximum(match_before(order, lcp, width), match_before(order[::-1], after[::-1], width)[::-1])
    earlier[order] = factor >= width
    any_[order] = np.maximum(lcp, after) >= width
    return earlier, any_


def _matched(keep_first: bool):
    """Runs sorted by (h, place) to the spans that have a match."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def spans(t: pa.Table) -> pa.RecordBatch | None:
            raw = t.column("bytes").to_pylist()
            data, owner, offset, at = _starts(raw)
            earlier, any_ = previous_factors(data, at, t.column("h").to_numpy()[owner])
            n, first = t.column("n").to_numpy(), t.column("first").to_numpy()
            hit = earlier if keep_first else any_ & (n[owner] == 1)
            owner, start = owner[hit], offset[hit] + first[owner[hit]]
            if not len(owner):
                return None
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(owner)) - 1
            take = pa.array(owner[i])
            one = t.combine_chunks()
            return pa.RecordBatch.from_arrays([one.column("doc_id").combine_chunks().take(take), one.column("th").combine_chunks().take(take), pa.array(start[i].astype(np.int32)), pa.array((start[j] + WIDTH).astype(np.int32))], ["doc_id", "th", "start", "end"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            h = t.column("h").to_numpy()
            other = np.flatnonzero(h != h[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut and (r := spans(t.slice(0, cut))) is not None:
                yield r
            held = t.slice(cut)
        if held is not None and held.num_rows and (r := spans(held)) is not None:
            yield r

    return work


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of crowded buckets to one row per suffix."""
    for b in _sliced(batches, 4096):
        if not b.num_rows:
            continue
        data, owner, offset, at = _starts(b.column("bytes").to_pylist())
        x, y = grams(data, WIDTH, 1)[at], grams(data, WIDTH, 77)[at]
        take = pa.array(owner)
        start = offset + b.column("first").to_numpy()[owner]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("th").take(take), b.column("n").take(take), pa.array(start.astype(np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["doc_id", "th", "n", "start", "x", "y"])


def repeated_spans(docs: DataFrame, scratch: Scratch, keep_first: bool = False) -> DataFrame:
    """(doc_id, th, start, end): byte spans, which may overlap, of strings that also start elsewhere.

    With ``keep_first``, of strings that also start earlier: the first copy in the order of (doc_id, th, start) stays.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = scratch.cut(runs(docs), "runs")
    # Written first: a join straight from two shuffles lets Spark split an anchor that very many texts share.
    buckets = scratch.cut(every.groupBy("h").agg(F.count("*").alias("m"), (F.min("c") != F.max("c")).alias("mixed")).where("m > 1").select("h", "mixed"), "buckets")
    shared = scratch.cut(every.join(buckets, "h"), "shared")
    scratch.drop(every)
    scratch.sweep()
    place = F.struct("doc_id", "th", "first", "size")
    equal = scratch.cut(shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("rep"), F.max("mixed").alias("mixed")), "equal")
    full = shared.select("doc_id", "th", "first", "size", "h", "c").join(equal.where("n > 1").select("h", "c", "rep"), ["h", "c"])
    if keep_first:
        full = full.where(~F.col("rep").eqNullSafe(place))
    spans = scratch.cut(full.select("doc_id", "th", F.col("first").alias("start"), (F.col("first") + F.col("size") - 1 + WIDTH).alias("end")), "full")
    scratch.drop(shared)
    reps = equal.where("mixed").select("rep.*", "h", "n")
    crowds = equal.where("mixed").groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > CROWD).select("h")
    crowds = scratch.cut(crowds, "crowds")
    near = scratch.cut(contexts(docs, reps), "contexts")
    scratch.drop(equal)
    scratch.sweep()
    usual = near.join(crowds, "h", "left_anti").repartition("h").sortWithinPartitions("h", "doc_id", "th", "first")
    some = usual.select("doc_id", "th", "h", "n", "first", "bytes").mapInArrow(_matched(keep_first), f"doc_id {kind}, th long, start int, end int")
    rows = near.join(crowds, "h", "left_semi").select("doc_id", "th", "n", "first", "bytes").mapInArrow(_exploded, f"doc_id {kind}, th long, n long, start int, x long, y long")
    names = rows.groupBy("x", "y").agg(F.sum("n").alias("m"), F.min(F.struct("doc_id", "th", "start")).alias("f")).where("m > 1").select("x", "y", "f")
    again = rows.join(names, ["x", "y"]).where(~F.col("f").eqNullSafe(F.struct("doc_id", "th", "start")) if keep_first else F.col("n") == 1)
    more = again.select("doc_id", "th", "start", (F.col("start") + WIDTH).alias("end"))
    return spans.unionByName(some).unionByName(more)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_first: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left)."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    spans = repeated_spans(own, scratch, keep_first).distinct()  # rows with one id and text give the same spans
    per = scratch.cut(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans").select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "spans")
    scratch.sweep()
    rows = own.join(per, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("doc_id", "text", F.col("spans.start").alias("start"), F.col("spans.end").alias("end"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            out: list[tuple] = []
            for t, s, e in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                t = t or b""
                if not s:
                    out.append((len(t), 0, 0, t))
                    continue
                a, z = np.array(s, np.int64), np.array(e, np.int64)
                order = np.argsort(a, kind="stable")
                a, z = a[order], np.maximum.accumulate(z[order])
                new = np.concatenate(([True], a[1:] > z[:-1]))
                i = np.flatnonzero(new)
                lo, hi = a[i], z[np.append(i[1:], len(a)) - 1]
                kept = b"".join(t[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(t)], strict=True))
                out.append((len(t), int((hi - lo).sum()), len(lo), kept))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
