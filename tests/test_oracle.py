"""Every query against SQL in another engine, on whole tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points

QUERIES = entry_points.QUERIES
SQL = entry_points.oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for costly in ("NestedLoop", "CartesianProduct", "Python"):
        assert costly not in plan
    assert difference(result, duck, SQL[name]) == ""


def test_entry_gives_rows(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["split_id", "role", "doc_id", "target"]
    assert result.count() > 0
