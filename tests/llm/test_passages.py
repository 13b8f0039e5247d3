"""Repeated passages against brute force and their SQL."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from comparing import connect, duck_rows, spark_rows

from orrery.llm import passages, queries
from orrery.llm.common import Scratch

W = passages.WIDTH


def cut(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def brute(texts):
    """(n_words, n_removed, kept) of each text."""
    words = [cut(t) for t in texts]
    n = Counter(tuple(w[i : i + W]) for w in words for i in range(len(w) - W + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - W + 1) if n[tuple(w[i : i + W])] > 1 for p in range(i, i + W)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def texts():
    rnd = random.Random(13)
    some = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    long, line = some(3000), some(60)
    out = [None, "", " \n\t", "one", " ".join(some(34)), " ".join(some(35)), "a " * 100, "a b " * 60, "École\x0bnaïve\xa0x " * 40]
    out += [" ".join(long), " ".join(long[:400]), " ".join(long[300:900]), "\n".join(long[850:1500]), " ".join(some(50) + long[1000:1034] + some(50)), " ".join(some(50) + long[1000:1035] + some(50))]
    for _ in range(40):  # near copies, each with its own changes, and one frequent line
        near = [x if rnd.random() > 0.01 else f"z{rnd.randrange(99)}" for x in long[1200:1700]]
        out.append(" ".join(near[: rnd.randrange(500)] + line + near[rnd.randrange(400) :]))
    out += ["\t".join(line + line), " ".join(some(20) + line[:36] + line[:36] + some(20))]
    out += [" ".join(line[20:] + long[i : i + 80]) for i in range(0, 300, 7)]  # overlapping, none of which covers a whole path
    return out + [out[10], out[10], " ".join(some(150_000))]


DOCS = "doc_id long, text string, size int, th long, h string, a string, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[9], (9, "the same id"), (None, texts()[12]), (None, None), *[(None, texts()[20])] * 3]
    return spark.createDataFrame([(*r, 1, 2, "clash", "clash", "clash") for r in rows], DOCS).repartition(3)


def test_equals_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op13_repeated_passages(spark, str(tmp_path)).collect()
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, k, t) in zip(every, brute([t for _, t in every]), strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, rows), key=order) == sorted(want, key=order)


def test_long_spans_are_stretches_of_their_source(spark, docs):
    some = docs.where("doc_id IS NOT NULL AND text IS DISTINCT FROM 'the same id'").dropDuplicates(["doc_id"])
    rows = passages.dedup(some).collect()
    at = {r["doc_id"]: cut(r["text"]) for r in some.collect()}
    words = {}
    for r in rows:
        for s in r["spans"]:
            for k in range(s["n_words"]):
                words.setdefault((s["path"], s["at"] + k), set()).add(at[r["doc_id"]][s["first"] + k])
    assert words and all(len(x) == 1 for x in words.values())
    assert max(s["n_words"] for r in rows for s in r["spans"]) > 500  # paths compact to long ones


def test_chains_compact_to_their_root(spark):
    rows = [(i, 7, 10 * i, 10, 100 + i, 101 + i) for i in range(37)] + [(90, 8, 0, 5, 500, 501), (91, 8, 5, 5, 501, 502), (92, 9, 0, 5, 501, 503)]
    paths = spark.createDataFrame(rows, "p long, doc long, first int, size int, head long, tail long")
    got = {r["p"]: (r["u"], r["base"], r["s_at"]) for r in passages.compacted(paths, Scratch(spark)).collect()}
    assert all(got[i] == (0, 10 * i, 0) for i in range(37))
    assert got[90] == (90, 0, 0) and got[91] == (91, 0, 5) and got[92] == (92, 0, 0)  # two ways on


def test_different_words_of_equal_hashes_are_an_error(spark):
    kind = "doc_id long, cells array<struct<u long, cell long, lo int, n int, words string, own boolean>>"
    source, part = (1, 0, 0, 4, "a b c d", True), (1, 0, 1, 2, "b c", False)
    passages.verify(spark.createDataFrame([(1, [source]), (2, [part, (*source[:5], False)]), (3, []), (4, None)], kind))
    for wrong in ((1, 0, 1, 2, "b x", False), (1, 0, 3, 2, "d e", False), (1, 1, 0, 1, "a", False)):
        with pytest.raises(RuntimeError):
            passages.verify(spark.createDataFrame([(1, [source]), (2, [part, wrong])], kind))


def test_digests_do_not_depend_on_the_place():
    t = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    t[200:300] = t[:100]
    first, size = np.array([3, 203, 3, 4]), np.array([20, 20, 21, 20])
    d = passages.digests(t, first, size)
    assert d[0] == d[1] and len(set(d.tolist())) == 3


def test_whole_tables_against_sql(spark):
    at = "/root/testdata/sf0.01"
    got = spark_rows(queries.op13_repeated_passages(spark, at))
    assert got[1] and got == duck_rows(connect(at), queries.OP13)


def test_empty_table(spark):
    assert passages.dedup(spark.createDataFrame([], DOCS)).count() == 0
