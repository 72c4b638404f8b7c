"""Every registered query that has SQL gives the same rows in DuckDB."""

import pytest
from compare import connect, differences

from palisade.plans import oracles, queries

SQL = oracles()
QUERIES = queries()
@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, duck, name):
    assert differences(QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
