from __future__ import annotations

import pytest

import __spark_entry__ as registry
from tests.compare import duckdb_rows, spark_rows


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, small, name):
    assert spark_rows(spark, name, small) == duckdb_rows(name, small)


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"nation", "biz_month", "orders", "revenue", "batch_date"}
