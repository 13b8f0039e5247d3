"""The pipeline against plain Python over a whole small table."""

import re

import corpus_pipeline
from test_nearcopies import five, similar
from orrery.llm import decontaminate, pieces, pii, quality

AT = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "personal data", "SentencePiece encoding"]
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.join(quality.judged(docs).where("kept").select("doc_id"), "doc_id").collect()}
    sets = {i: five(t) for i, t in rows.items()}
    kept, left = [], sorted(rows)
    while left:  # a group is what links of five words and 0.8 reach; its smallest id stays
        front, left = [left[0]], left[1:]
        kept.append(front[0])
        while front:
            x = front.pop()
            near = [y for y in left if similar(sets[x], sets[y])]
            front += near
            left = [y for y in left if y not in near]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = set()
    for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect():
        w = words(r["text"])
        wins |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in wins}
    clean = [i for i in kept if not any(tuple(w[k : k + n]) in wins for w in [words(rows[i])] for n in sizes for k in range(len(w) - n + 1))]
    p, crf = pieces.load(), pii.model()
    want = {}
    for i in clean:
        base = [pii.base_spans(rows[i])]
        text = pii.redacted(rows[i], base[0] + pii.added_spans([rows[i]], base, crf)[0])
        want[i] = list(pieces.encode(text, p))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, AT).collect()}
    assert got == want


def test_stages_keep_columns_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, AT)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert decontaminate.WINDOW == 10
