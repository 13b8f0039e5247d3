"""The filter audit against its SQL, the definition, and cases made for it."""

from itertools import permutations

import numpy as np
import pytest
from comparing import connect, duck_rows, spark_rows

from orrery.llm import interaction, queries

LONG = " ".join(f"w{i}" for i in range(250))
DOCS = "doc_id long, text string, lang string, mask int, n long, part string, digest string, good int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("audit")
    texts = [None, "", " \t", LONG, LONG, LONG.upper(), LONG + " #", "a " * 300, "a " * 300, "É" * 10, LONG, "x " * 150_000, "A|B", " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(199))]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)] + [(3, LONG, "en"), (3, "again", "en"), (None, LONG, "en"), (None, "no id", "fr"), (-5, LONG, "fr")]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, 1), (5, None, None), (None, 1, 1), (999, 1, 1), (7, 0, 1), (-5, 2, 2)]
    spark.createDataFrame([(*r, 9, 9, "clash", "clash", 9) for r in rows], DOCS).coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(*r, "clash", "clash") for r in labels], "doc_id long, quality int, toxic int, text string, lang string").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_small_cases(spark, folder):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cols, rows = spark_rows(queries.op11_filter_interactions(spark, folder))
    assert (cols, rows) == duck_rows(con, queries.OP11)
    assert len(rows) == 4 * 600  # en, de, fr and the empty string


def test_whole_tables(spark):
    at = "/root/testdata/sf0.01"
    cols, rows = spark_rows(queries.op11_filter_interactions(spark, at))
    assert rows and (cols, rows) == duck_rows(connect(at), queries.OP11)


@pytest.mark.parametrize("n", range(1, 7))
def test_the_walk_visits_every_order_once_by_single_swaps(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in interaction.transpositions(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_walk_equals_the_definition():
    letters, rnd = "PQRS", np.random.default_rng(3)
    table = rnd.integers(0, 9, (16, 3))
    rows = interaction.walk(table, letters)
    assert len(rows) == 24 * 4
    total = dict.fromkeys(range(4), 0)
    for name, step, f, kept, removed, redundant, unique, good, toxic, _ in rows:
        before = sum(1 << letters.index(x) for x in name[: step - 1])
        gone = [m for m in range(16) if m >> f & 1 and not m & before]
        assert letters[f] == name[step - 1] and unique == table[1 << f, 0]
        assert (removed, good, toxic) == tuple(sum(table[m, k] for m in gone) for k in range(3))
        assert redundant == sum(table[m, 0] for m in range(16) if m >> f & 1 and m & before)
        assert kept == sum(table[m, 0] for m in range(16) if not m & (before | 1 << f))
        total[f] += removed
    assert all(r[-1] == total[r[2]] for r in rows)


def test_empty_tables_and_other_filters(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    assert interaction.audit(docs.limit(0), labels).count() == 0
    assert interaction.audit(docs, labels.limit(0)).selectExpr("max(good_lost)", "max(toxic_lost)").first() == (0, 0)
    two = (interaction.Filter("Z", "n_chars > 100"), interaction.Filter("Y", "n_words = 0"))
    rows = interaction.audit(docs, labels, two).collect()
    assert {r["filter_order"] for r in rows} == {"ZY", "YZ"} and {r["step"] for r in rows} == {1, 2}
    with pytest.raises(ValueError):
        interaction.audit(docs, labels, ())
