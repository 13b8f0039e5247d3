"""Every query of the library against its SQL, over tables in which each of them has rows."""

import pytest
from comparing import connect, duck_rows, spark_rows

import __spark_entry__ as entry
from orrery.plans import catalog

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = spark_rows(catalog.queries()[name](spark, FOLDER))
    assert got[1] and got == duck_rows(duck, catalog.oracle_sql()[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
