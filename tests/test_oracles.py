import pytest

from nearfield.plans import store_checks, vector_queries
from tests.oracle import DATA, check

ALL = vector_queries.QUERIES | store_checks.QUERIES
SQL = vector_queries.ORACLES | store_checks.ORACLES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    check(spark, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert ALL[name](spark, DATA).count() > 0


def test_recall_of_graph_search(spark):
    got = vector_queries.ann_recall(spark, DATA).first()
    assert got["recall"] >= 0.9 and got["n"] == 250


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
