"""SimHash, repeated bytes and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from orrery.llm import queries, simhash, suffixes
from orrery.llm.common import Scratch
from orrery.llm.components import components


def fingerprint(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    """Smallest member of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(3, 200))) for _ in range(30)]
    near = [" ".join(w if rnd.random() > 0.01 else "zzz" for w in b.split()) for b in base for _ in range(3)]
    return [None, "", "  \n", "One two", "one TWO", *base, *base[:5], *near, "É e " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts())] + [(7, texts()[7], "again", 4), (None, "a text without an id", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, root int").repartition(3)


def test_fingerprints_and_components(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op6_simhash(spark, str(tmp_path)).collect()
    want = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in rows) == sorted((i or -1, f"{f:016x}") for i, f in want)
    root = groups(sorted({f for _, f in want}), lambda a, b: (a ^ b).bit_count() <= 4)
    low = defaultdict(list)
    for i, f in want:
        if i is not None:
            low[root[f]].append(i)
    for r in rows:
        assert r["component_id"] == min(low[root[int(r["fingerprint"], 16)]], default=None)


def test_every_close_pair_shares_a_key():
    rnd = np.random.default_rng(1)
    seg = simhash._segments()
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rnd.choice(64, 4, replace=False))
        masks = [seg[s] | seg[(s + 1) % 10] | seg[(s + o) % 10] for s in range(10) for o in (2, 3)]
        assert any(not diff & m for m in masks)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    fps = {int(x) for x in rnd.integers(0, 1 << 62, 40)}
    fps |= {f ^ (1 << int(b)) for f in list(fps)[:10] for b in rnd.integers(0, 60, 12)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for cell in (4, 2048):
        monkeypatch.setattr(simhash, "CELL", cell)
        scratch = Scratch(spark)
        got = {r["node"]: r["root"] for r in components(simhash.links(df, scratch), scratch).collect()}
        want = groups(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 4)
        assert {f: got.get(f, f) for f in fps} == want


def test_one_of_each_group_stays(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    of = groups(sorted({fingerprint(t) for t in [*texts(), "a text without an id"]}), lambda a, b: (a ^ b).bit_count() <= 4)
    rows = kept.collect()
    assert sorted(of[fingerprint(r["text"])] for r in rows) == sorted(set(of.values()))


def test_components_of_a_path_and_nothing(spark):
    df = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(5, 5), (None, 3), (900, 800), (800, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(201)} | {800: 800, 900: 800}
    assert components(df.limit(0), Scratch(spark)).count() == 0


def repeated(rows):
    """doc -> set of removed byte positions, by definition."""
    seen = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for i in range(len(raw) - 199):
            seen[raw[i : i + 200]].append((k, i))
    out = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                out[k].update(range(i, i + 200))
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeated_bytes(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rnd = random.Random(3)
    make = lambda n: "".join(rnd.choice("abcdefg é\n") for _ in range(n))
    shared, other = make(260), make(205)
    rows = [(0, None), (1, ""), (2, "x" * 900), (3, make(500)), (4, make(40) + shared + make(60)), (5, make(90) + shared[:230] + make(10)), (6, shared[20:] + make(70)), (7, other + make(30) + other), (8, make(700)), (9, "y" * 199), (10, "y" * 200), (None, make(50) + other)]
    rows += [(11, make(300)), (11, make(300)), (3, rows[3][1]), (12, ("ab" * 300) + make(50)), (13, "abc" * 200)]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, th int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_repeated_bytes(spark, str(tmp_path)).collect()
    want = []
    for (i, t), gone in zip(rows, repeated(rows), strict=True):
        raw = (t or "").encode()
        left = bytes(c for k, c in enumerate(raw) if k not in gone)
        want.append((i, len(raw), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(left).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_factors_are_the_definition():
    rnd = random.Random(12)
    for _ in range(300):
        width = rnd.choice([8, 9, 13, 20, 33])
        data = np.frombuffer("".join(rnd.choice("ab") for _ in range(rnd.randint(width, 120))).encode() * rnd.choice([1, 1, 3]), np.uint8)
        at = np.array(sorted(rnd.sample(range(len(data) - width + 1), rnd.randint(1, len(data) - width + 1))))
        bucket = np.array([rnd.randrange(2) for _ in at])
        raw, text = [data[i : i + width].tobytes() for i in at], data.tobytes()
        order, lcp = suffixes.suffix_array(data, at, bucket, width)
        assert order.tolist() == sorted(range(len(at)), key=lambda k: (bucket[k], raw[k], k))
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            same = next((n for n in range(width) if raw[a][n] != raw[b][n]), width) if bucket[a] == bucket[b] else 0
            assert lcp[k] == same
        earlier, any_ = suffixes.previous_factors(data, at, bucket, width)
        for k in range(len(at)):
            twins = [j for j in range(len(at)) if j != k and bucket[j] == bucket[k] and raw[j] == raw[k]]
            assert any_[k] == bool(twins) and earlier[k] == any(j < k for j in twins), text
        # In any other order of the suffixes, too, smaller positions give the longest earlier match.
        shuffled = np.array(rnd.sample(range(len(at)), len(at)))
        common = np.array([0] + [rnd.choice([0, width, width]) for _ in at[1:]])
        got = np.maximum(suffixes.match_before(shuffled, common, width), suffixes.match_before(shuffled[::-1], np.append(common[1:], 0)[::-1], width)[::-1]) >= width
        for k in range(len(at)):
            lo = k
            while common[lo] >= width:
                lo -= 1
            hi = k
            while hi + 1 < len(at) and common[hi + 1] >= width:
                hi += 1
            assert got[k] == any(shuffled[j] < shuffled[k] for j in range(lo, hi + 1))


def test_a_text_beyond_one_chunk(spark):
    rnd = random.Random(2)
    part = "".join(rnd.choices("abcdefgh \n", k=3000))
    filler = "".join(rnd.choices("ijklmnop", k=4_300_000))
    docs = spark.createDataFrame([(1, part + filler), (None, filler[-1000:] + part)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.dedup(docs).collect()}
    assert got == {1: (4000, 2), None: (4000, 1)}


def test_first_copy_stays(spark):
    s = "".join(random.Random(9).choices("qwertz ", k=250))
    docs = spark.createDataFrame([(1, "a" + s), (2, "b" + s), (3, s + "c")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.dedup(docs, keep_first=True).collect()} == {1: 0, 2: 250, 3: 250}


def test_repeated_rows_share_one_list_of_spans(spark, monkeypatch):
    text = "".join(random.Random(4).choices("asdfgh ", k=3000))
    docs = spark.createDataFrame([(None, text)] * 60 + [(1, "z" + text)], "doc_id long, text string")
    sizes, cut = [], Scratch.cut

    def seen(self, df, name):
        out = cut(self, df, name)
        if name == "spans":
            sizes.extend(len(r["spans"]) for r in out.collect())
        return out

    monkeypatch.setattr(Scratch, "cut", seen)
    rows = suffixes.dedup(docs).collect()
    assert len(rows) == 61 and {(r["doc_id"], r["n_removed"], r["n_spans"]) for r in rows} == {(None, 3000, 1), (1, 3000, 1)}
    assert max(sizes) <= 200  # the runs of one text, not those of sixty


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0 and suffixes.dedup(none).count() == 0
