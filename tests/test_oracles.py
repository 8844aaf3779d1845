"""Every query that has SQL gives the rows of the SQL; every other one runs and has columns."""

import pytest

from sievemark.plans import core_queries, reference_queries, source_queries
from tests.oracle import connect, same

ALL = {**core_queries.QUERIES, **reference_queries.QUERIES, **source_queries.QUERIES}
SQL = {**core_queries.SQL, **reference_queries.SQL, **source_queries.SQL}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, con, name):
    same(ALL[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    df = ALL[name](spark, data)
    assert df.columns and df.limit(3).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
