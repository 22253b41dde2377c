"""Lookups in the metadata tables, for one target or for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the window column of a table nobody describes.
DEFAULT_DATE_COLUMN = "data_date"


def source_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each target with the data sources it reads from directly."""
    sources = nodes.filter(F.col("label") == "DataSource").withColumnRenamed("en_name", "source")
    return edges.select("target", "source").distinct().join(sources, "source")


def source_descriptor(edges: DataFrame, sources: DataFrame, target: str) -> dict:
    """The connection row of one target; none, or one without a database, is an error."""
    wanted = edges.filter(F.col("target") == target).select(F.col("source").alias("source_name"))
    row = sources.join(wanted, "source_name", "left_semi").orderBy("source_name").limit(1).head()
    if row is None:
        raise LookupError(f"no data source for {target}")
    if not row["database"]:
        raise LookupError(f"data source {row['source_name']} names no database")
    return row.asDict()


def scripts_of(requests: DataFrame, scripts: DataFrame) -> DataFrame:
    """Text and window column per request ``(target_table, script_name)``.

    Of several stored rows the first by text is taken; requests without one keep nulls.
    """
    first = scripts.groupBy("target_table", "script_name").agg(
        F.min(F.struct("script_content", "target_dt_column")).alias("first")
    )
    found = requests.join(first, ["target_table", "script_name"], "left")
    return found.select(*requests.columns, "first.script_content", "first.target_dt_column")


def script_of(scripts: DataFrame, target_table: str, script_name: str) -> tuple[str, str | None]:
    """Text and window column of one script; a missing script is an error."""
    wanted = (F.col("target_table") == target_table) & (F.col("script_name") == script_name)
    row = scripts.filter(wanted).orderBy("script_content", "target_dt_column").limit(1).head()
    if row is None:
        raise LookupError(f"no script {script_name} for {target_table}")
    return row["script_content"], row["target_dt_column"]


def date_column_of(requests: DataFrame, nodes: DataFrame, scripts: DataFrame) -> DataFrame:
    """Window column per request ``(target_table, script_name)``.

    The node's own, else the script row's, else the default. A request without a script
    name takes any script row of its table (the first by text). Empty texts count as none.
    """
    def filled(name: str):
        return F.nullif(F.col(name), F.lit(""))

    of_node = nodes.select(
        F.col("en_name").alias("target_table"), F.col("target_dt_column").alias("of_node")
    )
    by_name = scripts.groupBy("target_table", "script_name").agg(
        F.min("target_dt_column").alias("of_script")
    )
    by_table = scripts.groupBy("target_table").agg(F.min("target_dt_column").alias("of_table"))
    return (
        requests.join(of_node, "target_table", "left")
        .join(by_name, ["target_table", "script_name"], "left")
        .join(by_table, "target_table", "left")
        .select(
            *requests.columns,
            F.coalesce(
                filled("of_node"), filled("of_script"),
                F.when(F.col("script_name").isNull(), filled("of_table")),
                F.lit(DEFAULT_DATE_COLUMN),
            ).alias("dt_column"),
        )
    )
