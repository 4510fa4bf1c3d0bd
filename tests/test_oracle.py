"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import TESTDATA, connect, difference

import __spark_entry__ as entry
from razao.plans.queries import QUERIES

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def test_entry_gives_rows(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["month", "transactions", "in_units", "out_units"]
    assert not rows.isEmpty()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name]) is None
