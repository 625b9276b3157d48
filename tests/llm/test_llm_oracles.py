"""Every llm query with SQL, against DuckDB at the smallest scale."""

import oracle
import pytest

from commentflow.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    assert oracle.compare(df, duck, oracles.oracle_sql()[name]) is None
