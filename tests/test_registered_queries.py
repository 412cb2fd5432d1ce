"""Every registered query against its SQL on the smallest tables."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.harness import compare, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, con, name):
    problem = compare(spark, con, sf, QUERIES[name], ORACLE[name])
    spark.catalog.clearCache()
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf, con, name):
    problem = compare(spark, con, sf, QUERIES[name], None)
    spark.catalog.clearCache()
    assert problem is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
