"""The same queries where one customer, day and order status hold a third of the orders."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import duckdb
import pytest

from tests.compare import duckdb_rows, spark_rows

HOT = (
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, "
    "CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1996-01-15 00:00:00' ELSE o_orderdate END AS o_orderdate, o_orderpriority "
    "FROM '{}'"
)


@pytest.fixture(scope="module")
def skewed(small):
    folder = Path(tempfile.mkdtemp(prefix="skew-"))
    for path in Path(small).glob("*.parquet"):
        if path.stem != "orders":
            shutil.copy(path, folder / path.name)
    source = Path(small) / "orders.parquet"
    duckdb.sql(f"COPY ({HOT.format(source)}) TO '{folder / 'orders.parquet'}' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "asof_latest", "keep_latest_n", "json_pack", "plan_order", "json_validate", "top_durations", "run_counts", "run_match",
        "failed_tasks", "report_lines", "run_fold", "window_replace", "windowed_transform", "period_range", "task_id",
    ],
)
def test_hot_keys(spark, skewed, name):
    assert spark_rows(spark, name, skewed) == duckdb_rows(name, skewed)
