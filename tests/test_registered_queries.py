"""Every registered query equals its SQL; those without SQL at least return rows."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    ok, note = compare(spark, duck, SF, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_entry_returns_evidence(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["position"] for r in rows} <= set(range(1, 13))
