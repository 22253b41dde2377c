"""Deleting old plans from a stored plan log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchline.operators.documents import KEEP_COUNT
from batchline.scratch import Scratch
from batchline.sinks.writes import among, partition_columns, partition_values, rewrite_partitions

_GROUP, _PLAN = ["dag_id", "exec_date"], ["run_id", "create_time"]


def outdated(plans: DataFrame, keep: int = KEEP_COUNT, parts: list[str] | None = None) -> DataFrame:
    """The plans beyond the newest ``keep`` of their DAG and date: key, partition and rows.

    Only key columns are read, and rows of one plan are counted before they are ranked.
    """
    own = plans.groupBy(*_GROUP, *_PLAN, *[p for p in parts or [] if p not in _GROUP]).agg(F.count("*").alias("rows"))
    newest = Window.partitionBy(*_GROUP).orderBy(F.desc("create_time"), "run_id")
    return own.withColumn("rank", F.dense_rank().over(newest)).filter(F.col("rank") > keep).drop("rank")


def delete_old_plans(spark: SparkSession, table: str, keep: int = KEEP_COUNT) -> int:
    """Delete all plans but the newest ``keep`` of each DAG and date; return the rows deleted.

    0 keeps all. Partitions without such plans are neither read (but for their keys) nor rewritten;
    an emptied one is dropped.
    """
    parts = partition_columns(spark, table)
    if not parts:
        raise ValueError(f"{table} has no partitions to rewrite")
    if keep <= 0:
        return 0
    scratch = Scratch(spark, "retention")
    try:
        old, _ = scratch.save(outdated(spark.table(table), keep, parts), "old")
        touched = partition_values(old, parts)
        plans = spark.table(table).filter(among(parts, touched)).alias("plans")
        same = [F.col(f"plans.{c}").eqNullSafe(F.col(f"old.{c}")) for c in (*_GROUP, *_PLAN)]
        rewrite_partitions(plans.join(old.alias("old"), same, "left_anti"), table, touched)
        return old.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).head()["n"]
    finally:
        scratch.close()
