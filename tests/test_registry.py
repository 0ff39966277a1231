import pytest

from docloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, against_sql):
    against_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.count()


@pytest.mark.parametrize("name", ["knn_pruned_recall", "knn_pruned_chunks"])
def test_pruned_search_recall(name, spark, sf):
    assert QUERIES[name](spark, sf).first()["recall"] >= 0.9


def test_driver_contract(spark, sf):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
