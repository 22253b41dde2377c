"""Replacing a table or one partition at once.

New files are written beside the old ones, then one catalog statement makes the new folder the
location, then the old files go. Readers that plan before that statement see the old rows, later
ones the new; a run that dies at any step leaves one or the other, and what it left behind is
removed by the next. Nothing is written twice, and the rows may be read from the target itself.

A replacement of several partitions is one switch for each: every partition is old or new, the
table between the first and the last switch holds both kinds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from batchline.scratch import FileSystem
from batchline.sinks.tables import quoted

_TABLE_VERSIONS, _PARTITION_VERSIONS = "__versions", "_versions"


def _described(spark: SparkSession, table: str, spec: str = "") -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)} {spec}").collect()  # a row a column
    found: dict[str, str] = {}
    for row in rows:  # the partition's own details come before those of its table
        found.setdefault(row["col_name"], row["data_type"])
    return found


def publishable(spark: SparkSession, table: str) -> bool:
    """Whether the table's rows are parquet files that the catalog locates."""
    return _described(spark, table).get("Provider", "").lower() == "parquet"


def _beside(files: FileSystem, folder: str, current: str) -> str:
    """A new folder for a version; versions that nothing refers to are removed."""
    if files.exists(folder):
        for child in files.children(folder):
            if child.rstrip("/").rpartition("/")[2] != current.rstrip("/").rpartition("/")[2]:
                files.delete(child)
    return f"{folder}/{uuid.uuid4().hex}"


def publish_table(rows: DataFrame, table: str) -> None:
    """Make ``rows`` (aligned with the table) the whole content of a table without partitions."""
    spark = rows.sparkSession
    files, old = FileSystem(spark), _described(spark, table)["Location"].rstrip("/")
    new = _beside(files, old.partition(_TABLE_VERSIONS)[0] + _TABLE_VERSIONS, old)
    rows.write.parquet(new)
    spark.sql(f"ALTER TABLE {quoted(table)} SET LOCATION '{new}'")
    spark.catalog.refreshTable(quoted(table))
    files.delete(old)


def publish_partition(rows: DataFrame, table: str, spec: str, name: str) -> None:
    """Make ``rows`` (without the partition columns) the content of one partition.

    ``spec`` is its specification in SQL, ``name`` its folder's name.
    """
    spark = rows.sparkSession
    files, root = FileSystem(spark), _described(spark, table)["Location"].rstrip("/")
    known = not spark.sql(f"SHOW PARTITIONS {quoted(table)} PARTITION ({spec})").isEmpty()
    old = _described(spark, table, f"PARTITION ({spec})")["Location"] if known else f"{root}/{name}"
    new = _beside(files, f"{root}/{_PARTITION_VERSIONS}/{name}", old)
    rows.write.parquet(new)
    if known:
        spark.sql(f"ALTER TABLE {quoted(table)} PARTITION ({spec}) SET LOCATION '{new}'")
    else:
        spark.sql(f"ALTER TABLE {quoted(table)} ADD PARTITION ({spec}) LOCATION '{new}'")
    spark.catalog.refreshTable(quoted(table))
    if known:
        files.delete(old)
