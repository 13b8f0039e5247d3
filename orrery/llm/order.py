"""Training-order materialisation: token sequences written in a keyed random order.

Texts are encoded by a public byte-level vocabulary (exact for every text), joined
with an end mark and cut into sequences of ``LENGTH`` ids; they are written once as
a table whose rows carry their place (part, row), so retries and resumes see the
same numbers. Between the steps a sequence travels compressed. Places become dense indexes by prefix
sums over the parts, a small table. A keyed Feistel network
on the next power of two, with cycle-walking back into the range, permutes the
indexes: every sequence gets its own global slot, and any slot can be traced back
without a table. Slots are range-partitioned by shard; each task writes whole
shards of ``PER_SHARD`` records of fixed stride, under a temporary name first, so
a retried task replaces its shard by the same bytes. Record k of the order is at
byte (k mod PER_SHARD) * stride of shard k // PER_SHARD: readers go sequentially,
and resume at any slot by one seek.

Defined cases: null and empty texts give an end mark alone; an empty table gives no
sequences and no shards; repeated rows are sequences of their own; the last
sequence of a part is padded (``n_tokens`` says how much of it counts). Ids are
two bytes, little endian; larger vocabularies take four. Very long texts are encoded
whole. Sequences follow the splits of the input: the same files read with the same
settings give the same order, and the written table fixes it for good.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import Scratch

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits texts before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
PER_SHARD = 1024
PAD = 0
ROUNDS = 6
#: So many rows of two numbers are broadcast.
FEW = 1_000_000
#: Runs of blanks from this length on are cut out by hand, as the pattern's look-ahead would overflow; ids are the same.
RUN = 10_000
_LONG = re.compile(rf"[^\S\x1c-\x1f]{{{RUN},}}")


def _round(half: np.ndarray, key: int, n: int) -> np.ndarray:
    x = half.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    """A bijection of [0, 2^bits): halves swap roles each round, so odd widths work too."""
    low = bits // 2
    a, b = bits - low, low  # widths of the left and right part
    l, r = x >> np.uint64(low), x & np.uint64((1 << low) - 1)
    steps = list(range(ROUNDS))
    for n in reversed(steps) if back else steps:
        if n % 2:
            r = r ^ (_round(l, key, n) & np.uint64((1 << b) - 1))
        else:
            l = l ^ (_round(r, key, n) & np.uint64((1 << a) - 1))
    return (l << np.uint64(low)) | r


def permuted(index: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """Slots of indexes in [0, total), or with ``back`` the indexes of slots."""
    bits = max(2, int(total - 1).bit_length())
    x = _network(np.asarray(index, np.uint64), bits, key, back)
    while (out := x >= total).any():  # walk the cycle until it is back in range
        x[out] = _network(x[out], bits, key, back)
    return x.astype(np.int64)


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def encoder(ranks: dict[bytes, int]):
    """The encoder of a vocabulary; the end mark is the id after its last."""
    import tiktoken

    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, enc) -> list[int]:
    """The ids of a text. Of a run of blanks all but the last are one piece (all, at the end); the last goes with what follows."""
    if not text:
        return []
    if len(text) < RUN or not _LONG.search(text):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in _LONG.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def sequences(docs: DataFrame, text: str = "text", length: int = LENGTH, ranks: str = RANKS) -> DataFrame:
    """(part, row, n_tokens, packed): sequences of each input partition, their ids compressed."""
    loaded = load_ranks(ranks)
    end = max(loaded.values()) + 1
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
    shared = docs.sparkSession.sparkContext.broadcast(loaded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, row, rest = TaskContext.get().partitionId(), 0, array("i")
        enc, pack = encoder(shared.value), zstandard.ZstdCompressor(level=1).compress

        def out(ids: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
            nonlocal row
            raw = ids.astype(kind).reshape(-1, length)
            rows = list(range(row, row + len(raw)))
            row += len(raw)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(raw), pa.int32()), pa.array(rows, pa.int64()), pa.array(sizes, pa.int32()), pa.array([pack(x.tobytes()) for x in raw], pa.binary())], ["part", "row", "n_tokens", "packed"])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                for t in whole.column(0).slice(at, 512).to_pylist():
                    rest.extend(encode(t, enc))
                    rest.append(end)
                n = len(rest) // length
                if n:
                    yield out(np.array(rest[: n * length], np.int32), [length] * n)
                    rest = rest[n * length :]
        if len(rest):
            yield out(np.concatenate([np.array(rest, np.int32), np.full(length - len(rest), PAD, np.int32)]), [len(rest)])

    return docs.select(F.col(text).alias("text")).mapInArrow(work, "part int, row long, n_tokens int, packed binary")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def materialise(docs: DataFrame, path: str, text: str = "text", key: int = 20240607, length: int = LENGTH, per_shard: int = PER_SHARD, ranks: str = RANKS) -> DataFrame:
    """Write the shards to ``path`` (a URI all executors reach); one row per sequence: slot, shard, offset, n_tokens, sha256.

    The returned table is a written one: the shards are complete when this returns.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    table = scratch.cut(sequences(docs, text, length, ranks), "sequences")
    # One row for each input partition, and running sums within and over groups of them.
    parts = table.groupBy("part").agg((F.max("row") + 1).alias("n")).withColumn("g", F.floor(F.col("part") / 1024))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # a row for 1,024 parts
    tops = parts.groupBy("g").agg(F.sum("n").alias("gn")).select("g", F.coalesce(F.sum("gn").over(before), F.lit(0)).alias("top"))
    inside = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = scratch.cut(parts.join(tops, "g").select("part", "n", (F.col("top") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first")), "firsts")
    sums = firsts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("parts")).first()
    total = int(sums["total"])
    placed = table.join(F.broadcast(firsts) if sums["parts"] <= FEW else firsts, "part").select((F.col("first") + F.col("row")).alias("index"), "n_tokens", "packed")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = permuted(b.column(0).to_numpy(), total, key) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), b.column(1), b.column(2)], ["shard", "slot", "n_tokens", "packed"])

    shards = -(-total // per_shard)
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.mapInArrow(slots, "shard long, slot long, n_tokens int, packed binary").repartitionByRange(tasks, "shard").sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        held: list[tuple[int, int, bytes]] = []

        def finish() -> pa.RecordBatch:
            shard = held[0][0] // per_shard
            temp = f"{root}/_{shard_name(shard)}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as f:
                for _, _, ids in held:
                    f.write(ids)
            fs.move(temp, f"{root}/{shard_name(shard)}")
            stride = len(held[0][2])
            rows = [(s, shard, (s - shard * per_shard) * stride, n, hashlib.sha256(ids).hexdigest()) for s, n, ids in held]
            held.clear()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4])], ["slot", "shard", "offset", "n_tokens", "sha256"])

        for b in batches:
            for s, n, ids in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held and held[0][0] // per_shard != s // per_shard:
                    yield finish()
                held.append((s, n, unpack(ids)))
        if held:
            yield finish()

    done = scratch.cut(placed.mapInArrow(write, "slot long, shard long, offset long, n_tokens int, sha256 string"), "manifest")
    scratch.drop(table)
    return done


def read_slots(path: str, start: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> Iterator[np.ndarray]:
    """The sequences of slots start, start + 1, ...: one seek, then sequential reads."""
    fs, root = _filesystem(path)
    at = start
    while at < start + count:
        shard = at // per_shard
        stop = min(start + count, (shard + 1) * per_shard)
        with fs.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek((at - shard * per_shard) * length * width)
            while at < stop:
                yield np.frombuffer(f.read(length * width), "<u2" if width == 2 else "<u4")
                at += 1
