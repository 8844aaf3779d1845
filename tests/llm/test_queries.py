import pytest

from sievemark.llm import queries as q
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, data, name):
    same(q.QUERIES[name](spark, data), connect(data), q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, data, name):
    assert q.QUERIES[name](spark, data).limit(5).count() >= 0
