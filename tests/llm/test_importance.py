"""Importance resampling against a plain version of its contract."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orrery.llm import importance, queries

DOCS = "doc_id long, text string, weight long, score string, buckets int, n_words int, rank int"


def grams(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return w, [zlib.crc32(g.encode()) % 10_000 for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(docs, bench):
    """Rows (doc_id, n_features, weight, score, rank) of (doc_id, text) pairs."""
    each = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, g in each for b in g), Counter(b for x in bench for b in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for i, w, g in each:
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_small_cases(spark, tmp_path):
    texts = [None, "", "!!", "One", "one ONE one", "École ÉCOLE x1 " * 9, "a-b_c " * 30, *[f"w{i} " * 7 + f"v{i % 3} u{i % 5} " * 8 for i in range(60)], "long words " * 80_000]
    docs = [*enumerate(texts), (20, texts[20]), (21, "another text of the id " * 6), (None, texts[22]), (None, None), (None, texts[23])]
    bench = [None, "", "one w3 w3 v1 u2", "Long words, long"]
    spark.createDataFrame([(*d, 5, "clash", 5, 5, 5) for d in docs], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries.op12_importance(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == plain(docs, bench)


def test_whole_tables(spark):
    at = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{at}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = plain([(r["doc_id"], r["text"]) for r in docs], [r["text"] for r in bench])
    assert sorted((tuple(r) for r in queries.op12_importance(spark, at).collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 100


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_runs_of_words(longest):
    texts = ["a b c a b", "", "c", None, "b c a b c a", "é 1"]
    n, k, found = importance.features([t and t.encode() for t in texts], importance.Dictionary(), longest, 997)
    at = np.concatenate(([0], np.cumsum(k)))
    for i, t in enumerate(texts):
        w = (t or "").split()
        want = [zlib.crc32(" ".join(w[j : j + size]).encode()) % 997 for size in range(1, longest + 1) for j in range(len(w) - size + 1)]
        assert n[i] == len(w) and sorted(found[at[i] : at[i + 1]].tolist()) == sorted(want)


def test_small_blocks_and_empty_tables(spark, monkeypatch):
    rows = [(i, f"w{i % 7} " * 25) for i in range(50)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string")
    assert sorted(map(tuple, importance.resample(docs, target).drop("n_words").collect()), key=str) == plain(rows, ["w1 w2"])
    assert sorted(map(tuple, importance.resample(docs, target.limit(0)).drop("n_words").collect()), key=str) == plain(rows, [])
    assert importance.resample(docs.limit(0), target).count() == 0
    with pytest.raises(ValueError):
        importance.resample(docs, target, buckets=40_000)
