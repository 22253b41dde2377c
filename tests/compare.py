"""Running a registered query and its SQL over the same tables."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import duckdb

import __spark_entry__ as registry


def plain(value) -> str:
    if isinstance(value, float) and math.isfinite(value):
        return str(int(value)) if value == int(value) else repr(round(value, 6))
    if isinstance(value, datetime):
        return value.isoformat()
    return "null" if value is None else str(value)


def spark_rows(spark, name: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())


def duckdb_rows(name: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as connection:
        for path in Path(sf_dir).glob("*.parquet"):
            connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        result = connection.execute(registry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        places = [names.index(n) for n in sorted(names)]
        rows = sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())
    return sorted(names), rows
