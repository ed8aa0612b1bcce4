import pytest

from oracle import same
from taxonflow.plans import catalog, core_problems

QUERIES = {**core_problems.queries(), **catalog.queries()}
SQL = {**core_problems.oracle_sql(), **catalog.oracle_sql()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).count() == 1


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
