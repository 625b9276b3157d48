"""Every registered query against its SQL at the smallest scale."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.catalog.queries()
SQL = entry.oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert oracle.compare(QUERIES[name](spark, SF), duck, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
