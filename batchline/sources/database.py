"""Reading source databases and copying windows of them.

The driver jar is the user's. A window is pushed to the database as a predicate; a numeric
or date split column makes the read parallel.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# JDBC address and driver class per database type.
DIALECTS = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver"),
    "mssql": (
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    ),
}


class MissingWindowColumn(ValueError):
    """The source has no column of the window's name."""


@dataclass(frozen=True)
class Split:
    """How to divide a database read: bounds only shape the parts, no row is left out."""

    column: str
    lower: str
    upper: str
    parts: int


def jdbc_options(
    source: Mapping[str, object], fetch_size: int = 10_000, split: Split | None = None
) -> dict[str, str]:
    """Reader options of a source descriptor; an unknown database type is an error."""
    kind = str(source.get("db_type") or "").lower()
    if kind not in DIALECTS:
        raise ValueError(f"unknown database type: {source.get('db_type')}")
    address, driver = DIALECTS[kind]
    table = source["source_table"]
    if source.get("schema"):
        table = f"{source['schema']}.{table}"
    options = {
        "url": address.format(**source),
        "driver": driver,
        "dbtable": str(table),
        "user": str(source["username"]),
        "password": str(source["password"]),
        "fetchsize": str(fetch_size),
    }
    if split is not None:
        options |= {
            "partitionColumn": split.column, "lowerBound": split.lower,
            "upperBound": split.upper, "numPartitions": str(split.parts),
        }
    return options


def read_database(
    spark: SparkSession, source: Mapping[str, object], split: Split | None = None
) -> DataFrame:
    """The whole source table, typed as the database types it."""
    return spark.read.format("jdbc").options(**jdbc_options(source, split=split)).load()


def window_scan(
    df: DataFrame, column: str, start: date, end: date, on_missing: str = "error"
) -> DataFrame:
    """Rows with ``start <= column < end``, as a filter that reaches the scan.

    Without the column (names compare without case) this is an error, or with
    ``on_missing="full_scan"`` the whole source: then replace the whole target too.
    """
    if on_missing not in ("error", "full_scan"):
        raise ValueError(f"unknown on_missing: {on_missing}")
    names = {name.lower(): name for name in df.columns}
    if column.lower() not in names:
        if on_missing == "full_scan":
            return df
        raise MissingWindowColumn(f"{column} is not among {df.columns}")
    found = F.col(names[column.lower()])
    return df.filter((found >= F.lit(start)) & (found < F.lit(end)))
