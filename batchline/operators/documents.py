"""Versioned JSON documents: packing, validation, the version as of a date, retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchline.functions.periods import business_time, naive
from batchline.operators.numbers import numbered

# The plan document's version, its list fields and how many plans are kept.
PLAN_VERSION = "2.0"
LIST_FIELDS = ("scripts", "resource_scripts", "model_scripts")
KEEP_COUNT = 5


def pack_plans(scripts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The plan of every date as rows of one shape, whatever its size: ``exec_date, part, script_id, plan``.

    ``scripts`` has ``exec_date, script_id, target_table_label, level`` and whatever else a
    script row carries; ``dependencies`` has ``exec_date, script_id, depends_on``. A plan is one
    row with ``part`` ``plan``, which says how many scripts and waits belong to it, a row ``script``
    for every script, and a row ``wait`` for every script that it waits for. All rows are documents of
    one form and a plan is their union: the lists of the documents put together. So no plan and no
    script is gathered in one place. The order of a plan is ``execution_order``.

    Of rows with equal date and script the one with the greatest level stays, of those the greatest
    row; a null ``depends_on`` is no wait. A date with waits alone is a plan without scripts.
    """
    detail = [c for c in scripts.columns if c != "exec_date"]
    entry = F.struct("level", F.struct(*detail).alias("script"))
    one_each = scripts.groupBy("exec_date", "script_id").agg(F.max(entry).alias("entry"))
    waits = dependencies.filter("depends_on IS NOT NULL").select("exec_date", "script_id", "depends_on")

    def document(*fields: Column) -> Column:
        head = [F.date_format("exec_date", "yyyy-MM-dd").alias("exec_date"), F.lit(PLAN_VERSION).alias("version")]
        return F.to_json(F.struct(*head, *fields)).alias("plan")

    def row(part: str, script: Column, *fields: Column) -> list[Column | str]:
        return ["exec_date", F.lit(part).alias("part"), script.alias("script_id"), document(*fields)]

    def in_group(label: str) -> Column:
        is_in = F.coalesce(F.col("entry.script.target_table_label") == label, F.lit(False))
        return F.filter(F.array("script_id"), lambda _: is_in)

    of_scripts = one_each.select(
        *row(
            "script", F.col("script_id"), F.array("entry.script").alias("scripts"),
            in_group("DataResource").alias("resource_scripts"), in_group("DataModel").alias("model_scripts"),
        )
    )
    waited = F.create_map("script_id", F.array("depends_on")).alias("script_dependencies")
    of_waits = waits.select(*row("wait", F.col("script_id"), waited))
    counted = one_each.select("exec_date", F.lit(1).alias("script"), F.lit(0).alias("wait")).unionByName(
        waits.select("exec_date", F.lit(0).alias("script"), F.lit(1).alias("wait"))
    )
    heads = counted.groupBy("exec_date").agg(F.sum("script").alias("script_count"), F.sum("wait").alias("wait_count"))
    of_plan = heads.select(*row("plan", F.lit(None).cast(scripts.schema["script_id"].dataType), F.col("script_count"), F.col("wait_count")))
    return of_plan.unionByName(of_scripts).unionByName(of_waits)


def execution_order(plans: DataFrame, keys: Sequence[str] = ("exec_date",)) -> DataFrame:
    """The scripts of each plan in an order in which sources come first: ``*keys, script_id, place``.

    ``plans`` has rows of ``pack_plans``; ``keys`` tell one plan from another. Places count from 1, by
    level, then id (null first); a plan of any size is numbered piece by piece.
    """
    rows = plans.filter("part = 'script'")
    level = F.get_json_object("plan", "$.scripts[0].level").cast("bigint")
    levelled = rows.select(*keys, "script_id", level.alias("_level"))
    return numbered(levelled, list(keys), ["_level", "script_id"], "place").drop("_level")


def plan_log(
    plans: DataFrame, dag_id: str, run_id: str, logical_date: datetime, create_time: datetime
) -> DataFrame:
    """Rows to append to the plan log for the documents of one planning run.

    ``logical_date`` is naive UTC; the log also holds it as business time. Documents without
    ``script_id`` are logged without.
    """
    instant = naive(logical_date)
    parts = [c for c in ("part", "script_id") if c in plans.columns]
    return plans.select(
        F.lit(dag_id).alias("dag_id"), F.lit(run_id).alias("run_id"), instant.alias("logical_date"),
        business_time(instant).alias("local_logical_date"), "exec_date", *parts, "plan",
        naive(create_time).alias("create_time"),
    )


def plan_valid(plan: Column) -> Column:
    """A document with an ``exec_date`` whose list fields, where present, are lists."""
    document = F.try_parse_json(plan)

    def field(name: str) -> Column:
        return F.variant_get(document, f"$.{name}", "variant")

    ok = field("exec_date").isNotNull()
    for name in LIST_FIELDS:
        is_list = F.schema_of_variant(field(name)).startswith("ARRAY")
        ok = ok & (field(name).isNull() | is_list)
    return F.coalesce(ok, F.lit(False))


# what tells one saved plan from another; all rows (parts) of a plan share it
PLAN_KEY = ("dag_id", "exec_date", "logical_date", "run_id", "create_time")


def _plan_key(plans: DataFrame) -> list[str]:
    """A log without ``create_time`` holds each plan once."""
    return [c for c in PLAN_KEY if c in plans.columns]


def _same_plan(key: Sequence[str], found: str) -> Column:
    """The row's plan is that of the struct ``found``; times and run may be null in a log."""
    same = [F.col(c) == F.col(f"{found}.{c}") if c in PLAN_KEY[:2] else F.col(c).eqNullSafe(F.col(f"{found}.{c}")) for c in key]
    return reduce(and_, same)


def latest_as_of(requests: DataFrame, plans: DataFrame) -> DataFrame:
    """For ``dag_id, ds`` the latest plan of that date, else of the nearest earlier date.

    A plan is all its rows: one of several parts comes with ``part`` and ``script_id``. A run that
    saved its plan twice counts with the later one. Plans are first reduced to the last one per
    DAG and date (a partial aggregate over keys and times, without the documents), so the window
    that carries a plan forward sees at most one row per calendar day of a DAG, however many
    plans and requests there are; only documents of wanted plans are joined.
    """
    key = _plan_key(plans)
    last = plans.groupBy("dag_id", F.col("exec_date").alias("day")).agg(
        F.max(F.struct(*key[1:])).alias("found")
    )
    asked = requests.select("dag_id", F.col("ds").alias("day")).distinct()
    days = asked.join(last, ["dag_id", "day"], "full")
    back = Window.partitionBy("dag_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    carried = days.withColumn("found", F.last("found", ignorenulls=True).over(back))
    asof = carried.select("dag_id", F.col("day").alias("ds"), "found.*")
    matched = requests.join(asof, ["dag_id", "ds"], "left")
    parts = [c for c in ("part", "script_id") if c in plans.columns]
    of_plan = F.struct(*key).alias("of_plan")
    wanted = plans.join(matched.select(of_plan).distinct(), _same_plan(key, "of_plan"), "left_semi")
    documents = wanted.select(of_plan, *parts, "plan")
    return matched.join(documents, _same_plan(key, "of_plan"), "left").select(
        *requests.columns, "exec_date", "logical_date", "run_id", *parts, "plan"
    )


def latest_for(plans: DataFrame, dag_id: str, ds: str) -> DataFrame:
    """The same for one DAG and date: all rows of one plan, or none."""
    known = plans.filter((F.col("dag_id") == dag_id) & (F.col("exec_date") <= F.lit(ds).cast("date")))
    key = _plan_key(plans)
    newest = known.agg(F.max(F.struct(*key[1:])).alias("found")).select(F.lit(dag_id).alias("dag_id"), "found.*")
    return known.join(newest.select(F.struct(*key).alias("of_plan")), _same_plan(key, "of_plan"), "left_semi")


def keep_latest(plans: DataFrame, keep: int = KEEP_COUNT) -> DataFrame:
    """The newest ``keep`` plans per DAG and date, each with all its rows; 0 keeps all.

    Plans are told apart by ``run_id`` and ``create_time``. The rank limit is applied within each
    input partition before the shuffle, so a date with very many plans sends no more than the
    rows of ``keep`` plans per partition.
    """
    if keep <= 0:
        return plans
    newest = Window.partitionBy("dag_id", "exec_date").orderBy(F.desc("create_time"), "run_id")
    return plans.withColumn("_rank", F.dense_rank().over(newest)).filter(F.col("_rank") <= keep).drop("_rank")
