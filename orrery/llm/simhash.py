"""SimHash near-duplicates: pigeonring candidates, exact Hamming check, components.

A text's fingerprint has a bit set if over half of its shingle hashes have it.
Documents enter the join only as distinct fingerprints, so exact copies cost
nothing there. Two fingerprints at distance <= 4 are found by the pigeonring
principle: cut the 64 bits into ten segments on a ring; some segment starts a
chain whose first l segments differ in at most floor(4 l / 10) bits, for every l:
none in the first two, one in the first four, two in the first five. So with the
first two segments, the third or the fourth is equal, and a fingerprint sends
twenty keys: for each start, the two segments with the third, and with the
fourth. Where keys meet, the budgets of the whole chain prune candidates before
the full Hamming check.

Fingerprints with equal keys make a cell, of bounded size: a key that more than
``CELL`` share is dealt into pieces, and each pair of pieces is a cell. In a cell
groups grow from a pivot by vectorised distances; what a pivot has absorbed is
compared only with what is left, so a dense group costs about its own size and
gives the edges of a spanning forest, not all pairs. No link between groups is
lost: the edges of all cells connect whatever a chain of links connects.

Defined cases: null, empty and blank texts have fingerprint zero, which links like
any other; repeated rows each get their row; a component takes the smallest doc_id
that is not null (null if there is none). Very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Scratch
from orrery.llm.components import components

SHINGLE = 4
SEED = 42
TAU = 4
SEGMENTS = 10
CELL = 2048
SMALL = 12


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import xxhash

    # bytes.lower() maps A-Z alone, bytes.split() cuts at space and 9 to 13 alone.
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(ws))
    pairs = zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(ws) - k + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        total += np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bit pattern as a signed long."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(_fingerprints, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


def _segments() -> list[int]:
    """Bit masks of the ring's segments, in order."""
    cuts = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column) -> Column:
    """Array of (at, value): the masked fingerprint under each of the twenty masks."""
    seg = _segments()
    out = []
    for start in range(SEGMENTS):
        for other in (2, 3):
            m = seg[start] | seg[(start + 1) % SEGMENTS] | seg[(start + other) % SEGMENTS]
            out.append(F.struct(F.lit(start * 2 + other - 2).cast("short").alias("at"), fp.bitwiseAND(F.lit(_signed(m))).alias("value")))
    return F.array(*out)


def _linked(x: np.ndarray, y: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    """Do the pairs keep the budgets of the chain that starts at key ``at``, and the full distance?"""
    seg = np.array(_segments(), np.uint64)
    start = np.asarray(at) // 2
    diff = x ^ y
    ok = np.ones(diff.shape, bool)
    chain = np.zeros_like(start, np.uint64)
    for n in range(1, 6):
        chain = chain | seg[(start + n - 1) % SEGMENTS]
        if n >= 3:
            ok &= np.bitwise_count(diff & chain) <= n * TAU // SEGMENTS
    ok[ok] = np.bitwise_count(diff[ok]) <= TAU
    return ok


def grow(x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the linked fingerprints of one cell."""
    left, a, b = x, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            nxt = []
            for p in front:
                hit = _linked(left, np.broadcast_to(p, left.shape), at)
                if hit.any():
                    nxt.append(left[hit])
                    a.append(left[hit])
                    b.append(np.full(int(hit.sum()), p, np.uint64))
                    left = left[~hit]
                if not len(left):
                    break
            front = np.concatenate(nxt) if nxt else left[:0]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (at, value, lo, hi, fp) to edges; a cell may run over into the next batch."""
    names = ["at", "value", "lo", "hi", "fp"]

    def work(c: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        n = len(c["fp"])
        new = np.ones(n, bool)
        new[1:] = (c["at"][1:] != c["at"][:-1]) | (c["value"][1:] != c["value"][:-1]) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        of, fp = np.cumsum(new) - 1, c["fp"].view(np.uint64)
        out = []
        small = sizes <= SMALL
        for d in range(1, SMALL):
            i = np.flatnonzero((of[d:] == of[:-d]) & small[of[d:]]) if n > d else np.zeros(0, np.int64)
            i = i[fp[i] != fp[i + d]]
            hit = i[_linked(fp[i], fp[i + d], c["at"][i].astype(np.int64))]
            out.append((fp[hit], fp[hit + d]))
        for k in np.flatnonzero(~small):
            s = starts[k]
            out.append(grow(np.unique(fp[s : s + sizes[k]]), int(c["at"][s])))
        a, b = (np.concatenate([x[k] for x in out]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        if held is not None:
            c = {k: np.concatenate([held[k], c[k]]) for k in names}
        if not len(c["fp"]):
            continue
        last = np.ones(len(c["fp"]), bool)
        for k in names[:4]:
            last &= c[k] == c[k][-1]
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut and (r := work({k: v[:cut] for k, v in c.items()})) is not None:
            yield r
        held = {k: v[cut:] for k, v in c.items()}
    if held is not None and len(held["fp"]) and (r := work(held)) is not None:
        yield r


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints of column fp within the distance."""
    keyed = fps.select("fp", F.inline(_keys(F.col("fp"))))
    crowded = scratch.cut(keyed.groupBy("at", "value").agg(F.count("*").alias("n")).where(F.col("n") > CELL), "crowded")
    pieces = F.ceil(F.col("n") / (CELL // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    cells = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi"))))
    rows = keyed.join(crowded, ["at", "value"], "left").select("at", "value", "fp", F.inline(cells))
    dealt = rows.repartition("at", "value", "lo", "hi").sortWithinPartitions("at", "value", "lo", "hi")
    return dealt.select("at", "value", "lo", "hi", "fp").mapInArrow(_edges, "a long, b long")


def classes(docs: DataFrame, id_col: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp) per row, and (fp, root, component_id) per distinct fingerprint."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    marked = scratch.cut(fingerprints(own.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("doc_id"), "text")).select("doc_id.*", "fp"), "fingerprints")
    each = scratch.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(each.select("fp"), scratch), scratch)
    rooted = scratch.cut(each.join(roots, each["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = scratch.cut(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    return marked, scratch.cut(rooted.join(lows, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id."""
    marked, named = classes(docs, id_col, text, Scratch(docs.sparkSession))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its own columns: the smallest id, a null id last, then the smallest text hash.

    Of repeated rows with one id and text a single one stays.
    """
    scratch = Scratch(docs.sparkSession)
    marked, named = classes(docs, id_col, text, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    first = scratch.cut(marked.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.th"), "kept")
    first = first.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(id_col).alias("i"), F.xxhash64(F.col(text)).alias("h"))
    kept = rows.join(first, F.col("i").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_th")), "left_semi")
    return kept.dropDuplicates(["i", "h"]).select("d.*")
