"""Quality rules and decontamination: their SQL over cases made for them."""

import pytest
from comparing import connect, duck_rows, spark_rows

from orrery.llm import decontaminate, quality, queries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
ITEM = " ".join(WORDS)
DOCS = "doc_id long, text string, h long, d string, m int, w string, words string, n_words int"


def cases():
    texts = [None, "", " \t\n", "one", ITEM, ITEM.upper(), f"x {ITEM} y {ITEM}", " ".join(WORDS[:10]), " ".join(WORDS[:9]), "a b c d e f g h " * 3, "x\n" * 40, "Two Words", "two,words two words", "#$% " * 30, ("long " + ITEM + "\n") * 3000, "école ÉCOLE naïve " * 20, ITEM + " " + ITEM, "w" * 300, " ".join(f"single{i}" for i in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, ITEM), (4, "other text"), (None, ITEM), (None, None)]
    return [(i, t, 7, "clash", 1, "clash", "clash", 3) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("native")
    items = [(1, ITEM), (2, "two words"), (3, None), (4, ""), (5, ITEM), (10, "école École naïve"), (11, "w" * 300), (None, ITEM), (None, "two words"), (12, ITEM + " nu xi")]
    spark.createDataFrame(cases(), DOCS).coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_decontaminate"])
def test_small_cases(spark, folder, name):
    assert spark_rows(queries.queries()[name](spark, folder)) == duck_rows(duck(folder), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_decontaminate"])
def test_whole_tables(spark, name):
    at = "/root/testdata/sf0.001"
    assert spark_rows(queries.queries()[name](spark, at)) == duck_rows(connect(at), queries.oracle_sql()[name])


def test_shuffled_join_equals_broadcast(spark, folder, monkeypatch):
    want = spark_rows(queries.op8_decontaminate(spark, folder))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1)
    assert spark_rows(queries.op8_decontaminate(spark, folder)) == want


def test_empty_tables(spark, folder):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert quality.judged(docs).count() == 0 and quality.keep(docs).columns == docs.columns
    some = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r["contaminated"] for r in decontaminate.decontaminate(some, items).collect()} == {False}
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert decontaminate.clean(some, items).count() == some.count()


def test_stages_keep_the_columns_and_the_rest(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality.judged(docs)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count()
    marked = decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    clean = decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert clean.columns == docs.columns and clean.count() == marked.where("not contaminated").count()


def test_ablation_is_what_the_bits_say(spark, folder):
    rows = quality.ledger(spark.read.parquet(f"{folder}/documents.parquet"))
    bits = [r["fail_bits"] for r in rows.collect()]
    for r in quality.ablation(rows).collect():
        policy = {p.name: p for p in (quality.BASE, quality.STANDARD)}[r["policy"]]
        bit = next(x.bit for x in quality.RULES if x.name == r["rule"])
        hit = [b & quality.mask(policy) for b in bits]
        assert r["failed"] == sum(b >> bit & 1 for b in hit) and r["only_this_rule"] == sum(b == 1 << bit for b in hit)


def test_a_ledger_of_other_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = (quality.Rule(3, "too_short", "n_words < 20"), quality.Rule(0, "repeated_words", "100 * n_repeat_words > 30 * n_words"), quality.Rule(5, "long", "n_words > 100"))
    policy = quality.Policy("brief", 2, ("too_short", "long"))
    rows = quality.judged(docs, policy=policy, rules=rules).collect()
    assert {r["kept"] for r in rows} == {True, False}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["n_words"] <= 100)
    assert quality.keep(docs, policy=policy, rules=rules).count() == sum(r["kept"] for r in rows)


def test_main_path_has_no_python(spark, folder):
    for name in ("op2_quality_rules", "op8_decontaminate"):
        plan = queries.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
