"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle_check import connect, differences, entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, name, FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_a_stable_schema(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "transaction_id" and df.count() == 989
