"""Near copies of five words and a similarity of 0.8 against brute force."""

import random

import corpus_pipeline
import pytest
from test_copies import groups

from orrery.llm import nearcopies, simhash


def five(text):
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def texts():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choices(words, k=n) for n in (1, 4, 5, 6, 9, 14, 30, 60, 90, 150, 150, 400, 400, 900, 2500)]
    out = [None, "", " \n", "One two", "one TWO"]
    for b in base:
        out.append(" ".join(b))
        for share in (0.002, 0.01, 0.02, 0.03, 0.05):
            out += [" ".join(w if rnd.random() > share else rnd.choice(words) for w in b) for _ in range(3)]
        out.append(" ".join(b[: len(b) * 17 // 20]))
    line = " ".join(rnd.choices(words, k=40))
    return out + [line + " " + " ".join(rnd.choices(words, k=n)) for n in (5, 5, 8, 12, 40, 80)]


@pytest.mark.parametrize("cell, hashes, few", [(nearcopies.CELL, nearcopies.HASHES, nearcopies.BROADCAST_ROWS), (4, 2000, 0)])
def test_the_stage_links_from_0_8_on(spark, monkeypatch, cell, hashes, few):
    monkeypatch.setattr(nearcopies, "BROADCAST_ROWS", few)
    monkeypatch.setattr(nearcopies, "CELL", cell)
    monkeypatch.setattr(nearcopies, "HASHES", hashes)
    rows = list(enumerate(texts())) + [(7, texts()[7]), (None, texts()[40]), (None, "a text without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    sets = [five(t) for _, t in rows]
    of = groups(range(len(rows)), lambda a, b: similar(sets[a], sets[b]))
    want = {}
    for k, (i, t) in enumerate(rows):
        want.setdefault(of[k], []).append((i is None, i or 0, t or ""))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(map(min, want.values()))
    far = [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b]) and (simhash.fingerprint(rows[a][1]) ^ simhash.fingerprint(rows[b][1])).bit_count() > 4]
    assert len(far) > 20  # pairs that four bits of a fingerprint do not reach
