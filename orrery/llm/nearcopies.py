"""SimHash near copies from a similarity of 0.8 on: texts whose sets of five words overlap that far.

A text's set is that of the hashes of its runs of five words (of all its words if
it has fewer). Texts with equal sets enter as one. At a similarity of 0.8 fingerprints
of 64 bits differ in ten bits or so, and no index of that radius is selective, so the
fingerprints here have 256 bits, and candidates come from the sets themselves:

1. hashes that no other set has among its ``LOW`` smallest leave after one count; for
   every pair of what is left a set sends a key. Of a union in random order, at most one of the first ten is common to both sets with
   probability 4e-6 at a similarity of 0.8, less above; otherwise a key is shared.
   Sets of up to ten hashes lose nothing. Keys with one smallest member make one
   cell, as near copies share most of their keys;
2. in a cell, pigeonring chains of fingerprint segments within their budgets prune the
   pairs before the full Hamming check at ``TAU`` bits (at a similarity of 0.8 the
   distance is about 39, at most 48 on average for the smallest sets, with a deviation
   of six; unrelated texts differ in 128, with a deviation of eight). Sets of up to ten
   hashes pass. Components of these links hold every pair that counts;
3. within each component the whole sets are compared, and linked from 0.8 on.

In both comparisons groups grow from a pivot, as in :mod:`orrery.llm.simhash`:
what a pivot has absorbed is compared only with what is left, so the edges are a
spanning forest of all links. A cell of more than ``CELL`` sets, and a component of
more than ``HASHES`` hashes, is dealt into pieces; each pair of pieces is a cell.

Texts move only where they have to: keys of the sets to compare, and of the documents that
go, are few against the documents; counted and within ``BROADCAST_ROWS`` they meet the
documents where these are read. Beyond that, documents shuffle to them.

Defined cases: null, empty and blank texts have the empty set and are copies of each
other; repeated rows are one; ids may be null or repeated; an empty table stays empty;
other columns go along untouched, whatever their names; long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Scratch
from orrery.llm.components import components

SHINGLE = 5
SEED = 42
LOW = 10
TAU = 80
SEGMENTS = 16
CHAIN = 4
CELL = 4096
HASHES = 1_000_000
#: A table of keys is broadcast after a count, and only up to this many rows; a larger one shuffles.
BROADCAST_ROWS = 1_000_000


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of one text's shingles; none of a text without words."""
    import xxhash

    # As for fingerprints: A-Z alone are lowered, and space and 9 to 13 alone cut.
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(ws))
    pairs = zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(ws) - k + 1))


def fingerprint(hashes: np.ndarray) -> bytes:
    """The 256-bit SimHash of a set of hashes: a bit is set if it is in over half of them."""
    total = np.zeros(256, np.int64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        wide = np.empty((len(h), 4), np.uint64)
        for k in range(4):  # one hash gives four words
            x = h + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            wide[:, k] = x ^ (x >> np.uint64(27))
        total += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def close(fps: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which of the fingerprints (rows of 16-bit segments) are within ``TAU`` bits of p.

    Of segments on a ring whose differences sum up to TAU at most, one begins a chain
    whose first l segments differ in at most l TAU / SEGMENTS bits, for every l.
    """
    diff = np.bitwise_count(fps ^ p).astype(np.int16)
    budget, ok, run = TAU // SEGMENTS, np.ones(diff.shape, bool), np.zeros(diff.shape, np.int16)
    for n in range(CHAIN):
        run += np.roll(diff, -n, axis=1)
        ok &= run <= budget * (n + 1)
    out = ok.any(axis=1)
    out[out] = diff[out].sum(axis=1) <= TAU
    return out


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        sig, n, low, fp = [], [], [], []
        for t in b.column(2).to_pylist():
            s = shingles(t)
            sig.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            n.append(len(s))
            low.append(s[:LOW].view(np.int64))
            fp.append(fingerprint(s) if len(s) > LOW else b"")
        cols = [b.column(0), b.column(1), pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(low, pa.list_(pa.int64())), pa.array(fp, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "sig", "n", "low", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, sorted hashes) to a row (key, sig) for each pair of the hashes."""
    for b in batches:
        sig, out, row = b.column(0), [], []
        for i, values in enumerate(b.column(1).to_pylist()):
            v = np.array(values, np.int64).view(np.uint64)
            x, y = np.triu_indices(len(v), 1)
            key = v[x] * np.uint64(0x9E3779B97F4A7C15) + v[y] * np.uint64(0xC2B2AE3D27D4EB4F)
            out.append(key ^ (key >> np.uint64(29)))
            row.append(np.full(len(x), i))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), sig.take(pa.array(np.concatenate(row)))], ["key", "sig"])


def grow(sizes: np.ndarray, hits: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n members; ``hits`` says which of the given members a pivot links to.

    Members whose sizes rule a similarity of 0.8 out are not asked for.
    """
    left, edges = np.arange(len(sizes)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            p = front.pop()
            fit = (5 * sizes[left] >= 4 * sizes[p]) & (5 * sizes[p] >= 4 * sizes[left])
            asked = left[fit]
            if not len(asked):
                continue
            got = asked[hits(p, asked)]
            if len(got):
                edges += [(p, g) for g in got.tolist()]
                front += got.tolist()
                left = left[~np.isin(left, got)]
    return edges


def _common(raw: list[np.ndarray], p: int, asked: np.ndarray) -> np.ndarray:
    """How many hashes of set p each of the asked sets has."""
    lens = np.fromiter((len(raw[i]) for i in asked), np.int64, len(asked))
    flat, own = np.concatenate([raw[i] for i in asked]), np.sort(raw[p])
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    ends = np.concatenate(([0], np.cumsum(own[at] == flat)))
    stops = np.cumsum(lens)
    return ends[stops] - ends[stops - lens]


def _links(exact: bool):
    """Sorted rows (cell, lo, hi, sig, n, raw) to edges; a cell may run over into the next batch."""
    def edges(rows: dict[int, tuple[int, bytes]]) -> list[tuple[int, int]]:
        sigs = list(rows)
        sizes = np.array([rows[s][0] for s in sigs], np.int64)
        if exact:
            raw = [np.frombuffer(rows[s][1], np.uint64) for s in sigs]
        else:
            fps = np.frombuffer(b"".join([rows[s][1] or bytes(32) for s in sigs]), np.uint16).reshape(-1, SEGMENTS)

        def hits(p: int, asked: np.ndarray) -> np.ndarray:
            if exact:
                same = _common(raw, p, asked)
                return 5 * same >= 4 * (sizes[p] + sizes[asked] - same)
            return close(fps[asked], fps[p]) | (np.minimum(sizes[asked], sizes[p]) <= LOW)

        return [(sigs[a], sigs[b]) for a, b in grow(sizes, hits)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, out = None, {}, []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out.clear()
            return made

        for b in batches:
            for c, lo, hi, sig, n, raw in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (c, lo, hi) != cell:
                    if len(rows) > 1:
                        out += edges(rows)
                    cell, rows = (c, lo, hi), {}
                rows[sig] = (n, raw)
            if len(out) > 10_000:
                yield batch()
        if len(rows) > 1:
            out += edges(rows)
        if out:
            yield batch()

    return work


def _cells(pieces: Column) -> Column:
    own = F.pmod(F.xxhash64("sig"), pieces).cast("int")
    return F.transform(F.sequence(F.lit(0), (pieces - 1).cast("int")), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))


def _linked(rows: DataFrame, exact: bool) -> DataFrame:
    """(a, b) of rows (cell, lo, hi, sig, n, raw)."""
    dealt = rows.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return dealt.select("cell", "lo", "hi", "sig", "n", "raw").mapInArrow(_links(exact), "a long, b long")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, pieces, sig, n, text) to the same with the whole set for the text."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            raw = pa.array([shingles(t).tobytes() for t in part.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), raw], ["cell", "pieces", "sig", "n", "raw"])


def _small(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if a count says that it may be."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def groups(docs: DataFrame, id_col: str, text: str, scratch: Scratch) -> DataFrame:
    """(doc_id, th, root) per row: rows with one root are connected by similarities of 0.8 or more."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    marked = scratch.cut(own.mapInArrow(_marks, f"doc_id {kind}, th long, sig long, n long, low array<long>, fp binary"), "marked")
    some = F.min(F.struct("doc_id", "th")).alias("rep")
    sets = scratch.cut(marked.groupBy("sig").agg(some, F.min("n").alias("n"), F.min("low").alias("low"), F.min("fp").alias("raw")), "sets")
    single = sets.select("sig", F.explode("low").alias("v"))
    often = scratch.cut(single.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v"), "often")
    some = scratch.cut(single.join(often, "v"), "some")
    low = some.groupBy("sig").agg(F.array_sort(F.collect_list("v")).alias("low")).where("size(low) > 1")  # at most LOW of a set
    keyed = scratch.cut(low.mapInArrow(_keys, "key long, sig long"), "keys")
    shared = scratch.cut(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("sig").alias("cell")).where("m > 1").select("key", "cell"), "shared")
    met = scratch.cut(keyed.join(shared, "key").select("cell", "sig").distinct(), "met")
    scratch.drop(keyed)
    scratch.drop(shared)
    scratch.sweep()
    sizes = scratch.cut(met.groupBy("cell").agg(F.count("*").alias("m")), "sizes")
    pieces = F.when(F.col("m") > CELL, F.ceil(F.col("m") / (CELL // 2))).otherwise(1).cast("int")
    rows = met.join(sizes, "cell").join(sets.select("sig", "n", "raw"), "sig").select("cell", "sig", "n", "raw", F.inline(_cells(pieces)))
    loose = scratch.cut(components(_linked(rows, False), scratch), "loose")
    scratch.drop(met)
    scratch.sweep()
    near = scratch.cut(sets.join(loose, F.col("sig") == F.col("node")).select(F.col("root").alias("cell"), "sig", "n", F.col("rep.doc_id").alias("r_id"), F.col("rep.th").alias("r_th")), "near")
    dealt = near.groupBy("cell").agg(F.ceil(F.sum("n") / HASHES).cast("int").alias("pieces"))
    wanted = _small(scratch.cut(near.join(dealt, "cell"), "wanted"))
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))).select("cell", "pieces", "sig", "n", "text")
    whole = texts.mapInArrow(_whole, "cell long, pieces int, sig long, n long, raw binary")
    whole = whole.select("cell", "sig", "n", "raw", F.inline(_cells(F.col("pieces"))))
    roots = components(_linked(whole, True), scratch)
    return marked.join(roots, F.col("sig") == F.col("node"), "left").select("doc_id", "th", F.coalesce("root", "sig").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with its own columns: the smallest id, a null id last, then the smallest text hash.

    Of repeated rows with one id and text a single one stays.
    """
    scratch = Scratch(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    keys = lambda i, h: [F.coalesce(i.cast("string"), F.lit("")).alias("i"), i.isNull().alias("none"), h.alias("h")]
    own = scratch.cut(groups(docs, id_col, text, scratch).groupBy("doc_id", "th").agg(F.min("root").alias("root"), F.count("*").alias("n")), "groups")
    first = scratch.cut(own.groupBy("root").agg(F.min(order).alias("k"), F.count("*").alias("m")), "firsts")
    # What is not alone: documents that go, and kept ones of which there are several rows.
    several = own.join(first.where("m > 1"), "root").where(~F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th")).eqNullSafe(F.col("k")))
    gone = scratch.cut(several.select(*keys(F.col("doc_id"), F.col("th"))), "gone")
    twice = own.where("n > 1").select(*keys(F.col("doc_id"), F.col("th"))).join(gone, ["i", "none", "h"], "left_anti")
    twice = scratch.cut(twice, "twice")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *keys(F.col(id_col), F.xxhash64(F.col(text))))
    kept = rows.join(_small(gone), ["i", "none", "h"], "left_anti")
    if not twice.isEmpty():
        again = _small(twice)
        kept = kept.join(again, ["i", "none", "h"], "left_anti").unionByName(rows.join(again, ["i", "none", "h"], "left_semi").dropDuplicates(["i", "none", "h"]))
    return kept.select("d.*")
