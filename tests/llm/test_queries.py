import pytest

from docloom.llm import queries as Q

QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, against_sql):
    against_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() >= 0
