"""The execution plan of a date: which scripts run, and after which others."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchline.functions.periods import due_today
from batchline.functions.values import script_defaults, script_id
from batchline.operators import documents, graph, lineage
from batchline.scratch import Scratch, small_broadcasts


def due_tables(nodes: DataFrame, edges: DataFrame, exec_date: date) -> DataFrame:
    """Enabled tables whose frequency is due: that of their first script (by name)."""
    scripts, _ = lineage.table_scripts(nodes, edges)
    frequency = scripts.groupBy(F.col("target").alias("table_name")).agg(
        F.min(F.struct("script_name", "schedule_frequency")).alias("first")
    )
    enabled = lineage.enabled_targets(nodes, edges).join(frequency, "table_name", "left")
    return enabled.filter(
        due_today(F.col("first.schedule_frequency"), F.lit(exec_date))
    ).select("table_name")


def plan_for(
    nodes: DataFrame, edges: DataFrame, exec_date: date, direction: str = "downstream"
) -> DataFrame:
    """The plan of a date in rows of ``documents.pack_plans``: ``exec_date, part, script_id, plan``.

    Due tables and their direct sources, without what hangs on invalid tables; the scripts
    that fill them, what each waits for, and levels by which sources come first.
    """
    scratch = Scratch(nodes.sparkSession, "plan")
    with small_broadcasts(nodes.sparkSession):
        scheduled, _ = scratch.save(due_tables(nodes, edges, exec_date), "due")
        wanted, _ = scratch.save(lineage.passive_tables(scheduled, nodes, edges), "wanted")
        valid, _ = scratch.save(
            lineage.valid_tables(wanted.withColumnRenamed("table_name", "en_name"), edges, direction), "valid"
        )
        all_scripts, all_sources = lineage.table_scripts(nodes, edges)
        planned = valid.select(F.col("en_name").alias("target"), F.col("label").alias("target_table_label"))
        scripts = script_defaults(all_scripts.join(planned, "target"))
        sources = all_sources.join(planned.select("target"), "target", "left_semi")
        named, _ = scratch.save(
            scripts.withColumn("script_id", script_id(F.col("script_name"), F.col("target"))), "scripts"
        )
        needs, _ = scratch.save(lineage.script_dependencies(named, sources, edges), "needs")
        order = graph.levels(
            graph.as_edges(needs, "script_id", "depends_on"), named.select(F.col("script_id").alias("node"))
        ).withColumnRenamed("node", "script_id")
        day = F.lit(exec_date).alias("exec_date")
        rows, _ = scratch.save(
            named.join(order, "script_id").select(
                day, "script_id", "script_name", F.col("target").alias("target_table"), "target_table_label",
                "script_type", "update_mode", "schedule_frequency", "schedule_status", "level",
            ),
            "rows",
        )
    return documents.pack_plans(rows, needs.select(day, "script_id", "depends_on"))
