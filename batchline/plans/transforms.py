"""Running a transform for the period of a date and writing its result: step by step, or a stored
script from its metadata to its target."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from batchline.functions.periods import period_bounds
from batchline.functions.values import layer_of
from batchline.plans.templates import TemplateError, is_query, run_statement, split_insert, statements
from batchline.sinks.tables import create_from_metadata, create_like, create_window_target
from batchline.sinks.writes import grain_of, mode_of, write
from batchline.sources.metadata import date_column_of, script_of

PythonTransform = Callable[..., DataFrame]

BATCH_COLUMN = "batch_date"

_REGISTRY: dict[str, PythonTransform] = {}


def python_transform(name: str) -> Callable[[PythonTransform], PythonTransform]:
    """Register ``fn(spark, start_date, end_date, **params) -> DataFrame`` under a script name."""

    def register(function: PythonTransform) -> PythonTransform:
        _REGISTRY[name] = function
        return function

    return register


def sql_frame(
    spark: SparkSession, text: str, exec_date: date | str, frequency: str,
    params: Mapping[str, object] | None = None,
) -> DataFrame:
    """The query of a stored statement, bound to the period of the date.

    Of an ``INSERT`` only the query is run; its column list names the result's columns. Anything
    that is not one query, or one ``INSERT`` of a query, is refused before it runs.
    """
    start, end = period_bounds(exec_date, frequency)
    whole = statements(text)
    if len(whole) != 1:
        raise TemplateError(f"one statement is wanted, not {len(whole)}")
    _, columns, query = split_insert(whole[0])
    if not is_query(query):
        raise TemplateError(f"not a query: {query[:80]}")
    values = {"start_date": start, "end_date": end, **(params or {})}
    df = run_statement(spark, query, values)
    return df.toDF(*columns) if columns else df


def python_frame(
    spark: SparkSession, name: str, exec_date: date | str, frequency: str,
    params: Mapping[str, object] | None = None,
) -> DataFrame:
    """The result of a registered function for the period of the date."""
    if name not in _REGISTRY:
        raise LookupError(f"no transform is registered as {name}")
    start, end = period_bounds(exec_date, frequency)
    return _REGISTRY[name](spark, start, end, **(params or {}))


def store(
    df: DataFrame, table: str, exec_date: date | str, frequency: str, mode: str, **options
) -> int:
    """Create the target on first use, write the result and return its number of rows.

    ``replace_window`` replaces the period in ``options["column"]``; ``replace_batch`` the
    partition ``batch_date`` of the date. The target has the result's columns, the audit
    columns and, for batches, ``batch_date``; for windows it is partitioned by the window's date,
    so that a period rewrites only its own partitions.
    """
    spark = df.sparkSession
    day = date.fromisoformat(exec_date) if isinstance(exec_date, str) else exec_date
    if mode == "replace_batch":
        shape = df.selectExpr("*", "CAST(NULL AS date) AS batch_date")
        create_like(spark, shape, table, ["batch_date"])
    elif mode == "replace_window" and options.get("partition"):
        part = options["partition"]
        shape = df if part in df.columns else df.selectExpr("*", f"CAST(NULL AS date) AS `{part}`")
        create_like(spark, shape, table, [part])
    elif mode == "replace_window" and options.get("column"):
        create_window_target(spark, df, table, options["column"], grain_of(frequency))
    else:
        create_like(spark, df, table)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    write(counted, table, mode, window=period_bounds(day, frequency), batch_date=day, **options)
    return seen.get["rows"]


def run_script(
    spark: SparkSession, nodes: DataFrame, columns: DataFrame, scripts: DataFrame, target: str, script_name: str,
    exec_date: date | str, frequency: str, update_mode: str | None = None, manual: bool = False,
    params: Mapping[str, object] | None = None,
) -> int:
    """Run one stored script for the period of a date and return the rows it wrote.

    The text comes from ``scripts`` (a registered function of that name is taken instead), the
    target from ``nodes`` and ``columns``: made on first use in its layer, partitioned by
    ``batch_date``, the date of the run. The mode follows from ``update_mode`` and ``manual``. A
    run that is repeated gives the same table.
    """
    day = date.fromisoformat(exec_date) if isinstance(exec_date, str) else exec_date
    node = nodes.filter(F.col("en_name") == target).select(F.array("label").alias("labels"))
    found = node.select(layer_of(F.col("labels")).alias("layer")).head()
    if found is None:
        raise LookupError(f"metadata does not describe {target}")
    if script_name in _REGISTRY:
        df = python_frame(spark, script_name, day, frequency, params)
    else:
        text, _ = script_of(scripts, target, script_name)
        df = sql_frame(spark, text, day, frequency, params)
    create_from_metadata(spark, nodes, columns, target, BATCH_COLUMN)
    mode = mode_of(update_mode, manual)
    options = {}
    if mode == "replace_window":
        request = spark.createDataFrame([(target, script_name)], "target_table string, script_name string")
        options["column"] = date_column_of(request, nodes, scripts).head()["dt_column"]
        if options["column"].lower() not in [c.lower() for c in df.columns]:
            raise ValueError(f"{script_name} has no column {options['column']} to replace a window by")
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if mode != "replace_batch":
        rows = rows.withColumn(BATCH_COLUMN, F.lit(day))
    table = f"{found['layer']}.{target}"
    # staged: a script may read its own target
    staged = {"staged": True} if mode != "replace_window" else {}
    write(rows, table, mode, window=period_bounds(day, frequency), batch_date=day, **options, **staged)
    return seen.get["rows"]
