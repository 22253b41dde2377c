"""Periods, labels, lookups and statement texts over the derived metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.fixtures import table, view, with_views
from batchline.functions import periods, sqltext, values
from batchline.operators import lineage
from batchline.sinks.tables import table_ddl
from batchline.sources import metadata


def period_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, frequency = F.col("exec_date"), F.col("schedule_frequency")
    return view(spark, sf_dir, "schedules").select(
        day, frequency,
        periods.period_start(day, frequency).alias("start_date"),
        periods.period_end(day, frequency).alias("end_date"),
    )


def day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", periods.day_start_utc(day).alias("start_utc"), periods.day_end_utc(day).alias("end_utc")
    )


def due_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = periods.due_today(F.col("schedule_frequency"), F.col("exec_date"))
    return view(spark, sf_dir, "schedules").select("exec_date", "schedule_frequency", due.alias("due"))


def business_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", periods.business_date(F.col("ts")).alias("business_date"),
        periods.business_time(F.col("ts")).alias("business_time"),
    )


def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = periods.elapsed_seconds(F.col("start_date"), F.col("end_date"))
    return view(spark, sf_dir, "task_runs").select(
        "task_id", seconds.alias("seconds"), periods.hours_text(seconds).alias("hours_text"),
        periods.minutes_text(seconds).alias("minutes_text"),
        periods.local_time_text(F.col("end_date")).alias("ended_at"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("node_id") % 5 == 0, "DataResource")
    labels = F.array_compact(F.array(F.when(F.col("node_id") % 11 != 0, F.col("label")), more, F.lit("Table")))
    return view(spark, sf_dir, "nodes").select("en_name", labels.alias("labels"))


def layer_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("en_name", values.layer_of(F.col("labels")).alias("layer"))


def label_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("en_name", values.main_label(F.col("labels")).alias("label"))


def label_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = view(spark, sf_dir, "edges").select(F.col("source").alias("table_name"))
    return lineage.label_members(read, view(spark, sf_dir, "nodes"), "DataResource")


def enabled_by_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedules = view(spark, sf_dir, "nodes").select(
        F.col("en_name").alias("table_name"), F.col("schedule_status").alias("is_enabled"), "schedule_frequency", "update_mode"
    )
    return lineage.enabled_by_frequency(schedules, "monthly").select("table_name", "update_mode")


def script_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.script_defaults(view(spark, sf_dir, "edges"))


def task_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.array_compact(F.array("source_b", "source_a"))
    name, target = F.col("script_name"), F.col("target_table")
    return view(spark, sf_dir, "plan_scripts").select(
        target, values.task_id(name, sources, target).alias("task_id"),
        values.script_id(name, target).alias("script_id"),
    )


def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.source_of(view(spark, sf_dir, "edges"), view(spark, sf_dir, "nodes"))
    return found.select("target", "source", F.col("name").alias("source_name"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edges").select(F.col("target").alias("target_table"), "script_name").distinct()


def script_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.scripts_of(_requests(spark, sf_dir), view(spark, sf_dir, "scripts"))


def dt_column_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.date_column_of(
        _requests(spark, sf_dir), view(spark, sf_dir, "nodes"), view(spark, sf_dir, "scripts")
    )


def bound_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = sqltext.bound_fields(F.col("script_content"))
    return view(spark, sf_dir, "scripts").select("script_name", F.array_join(fields, ",").alias("fields"))


def select_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = F.map_entries(sqltext.select_aliases(F.col("script_content")))
    return view(spark, sf_dir, "scripts").select("script_name", F.inline(aliases).alias("field", "alias"))


def target_date_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("script_content")
    parsed = view(spark, sf_dir, "scripts").select(
        "script_name", sqltext.bound_fields(text).alias("fields"), sqltext.select_aliases(text).alias("aliases")
    )
    field = sqltext.target_date_field(F.col("fields"), F.col("aliases"))
    return parsed.select("script_name", field.alias("date_field"))


def insert_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("script_content")
    return view(spark, sf_dir, "scripts").select(
        "script_name", sqltext.insert_target(text).alias("insert_target"),
        sqltext.window_delete(text).alias("window_delete"),
    )


def ddl_from_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes").filter("label <> 'DataSource'")
    return table_ddl(nodes, view(spark, sf_dir, "columns")).drop("layer")


QUERIES = {
    "period_range": period_range,
    "day_range": day_range,
    "due_today": due_today,
    "business_date": business_date,
    "duration_text": duration_text,
    "layer_route": layer_route,
    "label_pick": label_pick,
    "label_semi": label_semi,
    "enabled_by_freq": enabled_by_freq,
    "script_defaults": script_defaults,
    "task_id": task_id,
    "source_lookup": source_lookup,
    "script_lookup": script_lookup,
    "dt_column_pick": dt_column_pick,
    "bound_fields": bound_fields,
    "select_aliases": select_aliases,
    "target_date_field": target_date_field,
    "insert_target": insert_target,
    "ddl_from_metadata": ddl_from_metadata,
}

_STEP = "CASE schedule_frequency WHEN 'daily' THEN 'day' WHEN 'weekly' THEN 'week' WHEN 'monthly' THEN 'month' " \
    "WHEN 'quarterly' THEN 'quarter' ELSE 'year' END"
_LENGTH = "CASE schedule_frequency WHEN 'daily' THEN INTERVAL 1 DAY WHEN 'weekly' THEN INTERVAL 7 DAY " \
    "WHEN 'monthly' THEN INTERVAL 1 MONTH WHEN 'quarterly' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 YEAR END"
_START = f"CAST(date_trunc({_STEP}, exec_date) AS date)"
_LABELLED = (
    ", l AS (SELECT en_name, [CASE WHEN node_id % 11 <> 0 THEN label END, "
    "CASE WHEN node_id % 5 = 0 THEN 'DataResource' END, 'Table'] AS labels FROM nodes) "
)

ORACLE = {
    "period_range": with_views(
        ["schedules"],
        f"SELECT exec_date, schedule_frequency, {_START} AS start_date, CAST({_START} + {_LENGTH} AS date) AS end_date FROM schedules",
    ),
    "day_range": "SELECT o_orderkey, date_trunc('day', o_orderdate) - INTERVAL 8 HOUR AS start_utc, "
    "date_trunc('day', o_orderdate) + INTERVAL 16 HOUR AS end_utc FROM orders",
    "due_today": with_views(
        ["schedules"],
        f"SELECT exec_date, schedule_frequency, CAST({_START} + {_LENGTH} AS date) = CAST(exec_date + INTERVAL 1 DAY AS date) AS due FROM schedules",
    ),
    "business_date": "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS date) AS business_date, ts + INTERVAL 8 HOUR AS business_time FROM events",
    "duration_text": with_views(
        ["task_runs"],
        ", s AS (SELECT *, date_diff('second', start_date, end_date) AS n FROM task_runs) "
        "SELECT task_id, CAST(n AS double) AS seconds, coalesce((n // 3600) || '小时 ' || (n % 3600 // 60) || '分钟 ' || (n % 60) || '秒', 'N/A') AS hours_text, "
        "coalesce((n // 60) || '分钟 ' || (n % 60) || '秒', 'N/A') AS minutes_text, "
        "coalesce(strftime(end_date + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S'), 'N/A') AS ended_at FROM s",
    ),
    "layer_route": with_views(
        ["nodes"], f"{_LABELLED} SELECT en_name, CASE WHEN list_contains(labels, 'DataResource') THEN 'ods' ELSE 'ads' END AS layer FROM l"
    ),
    "label_pick": with_views(
        ["nodes"],
        f"{_LABELLED} SELECT en_name, CASE WHEN list_contains(labels, 'DataModel') THEN 'DataModel' WHEN list_contains(labels, 'DataResource') "
        "THEN 'DataResource' WHEN list_contains(labels, 'DataSource') THEN 'DataSource' END AS label FROM l",
    ),
    "label_semi": with_views(
        ["nodes", "edges"],
        "SELECT source AS table_name FROM edges WHERE source IN (SELECT en_name FROM nodes WHERE label = 'DataResource')",
    ),
    "enabled_by_freq": with_views(
        ["nodes"], "SELECT en_name AS table_name, update_mode FROM nodes WHERE schedule_status AND schedule_frequency = 'monthly'"
    ),
    "script_defaults": with_views(
        ["edges"],
        "SELECT target, source, rel, coalesce(script_name, target || '_script.py') AS script_name, coalesce(script_type, 'python_script') AS script_type, "
        "coalesce(update_mode, 'append') AS update_mode, coalesce(schedule_frequency, 'daily') AS schedule_frequency, "
        "coalesce(schedule_status, true) AS schedule_status FROM edges",
    ),
    "task_id": with_views(
        ["plan_scripts"],
        ", s AS (SELECT *, regexp_replace(script_name, '\\.[^.]*$', '') AS stem FROM plan_scripts) "
        "SELECT target_table, CASE WHEN script_name = 'load_file.py' THEN stem || '_' || target_table "
        "WHEN source_b IS NULL THEN stem || '_' || source_a || '_to_' || target_table "
        "ELSE stem || '_' || least(source_a, source_b) || '_' || greatest(source_a, source_b) || '_to_' || target_table END AS task_id, "
        "replace(script_name, '.', '_') || '_' || target_table AS script_id FROM s",
    ),
    "source_lookup": with_views(
        ["nodes", "edges"],
        "SELECT DISTINCT target, source, n.name AS source_name FROM edges JOIN nodes n ON n.en_name = source AND n.label = 'DataSource'",
    ),
    "script_lookup": with_views(
        ["edges", "scripts"],
        "SELECT r.*, s.script_content, s.target_dt_column FROM (SELECT DISTINCT target AS target_table, script_name FROM edges) r "
        "LEFT JOIN scripts s ON s.target_table = r.target_table AND s.script_name = r.script_name",
    ),
    "dt_column_pick": with_views(
        ["nodes", "edges", "scripts"],
        "SELECT r.*, coalesce(n.target_dt_column, s.target_dt_column, 'data_date') AS dt_column "
        "FROM (SELECT DISTINCT target AS target_table, script_name FROM edges) r LEFT JOIN nodes n ON n.en_name = r.target_table "
        "LEFT JOIN scripts s ON s.target_table = r.target_table AND (s.script_name = r.script_name OR r.script_name IS NULL)",
    ),
    "bound_fields": with_views(
        ["scripts"],
        "SELECT script_name, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(script_content, "
        "'([\\w.()]+) (?:>=|<) ''\\{\\{', 1), lambda f: regexp_replace(f, '^\\w+\\((.*)\\)$', '\\1')))), ',') AS fields FROM scripts",
    ),
    "select_aliases": with_views(
        ["scripts"],
        ", i AS (SELECT script_name, unnest(string_split(regexp_extract(script_content, 'SELECT (.*?) FROM', 1), ',')) AS item FROM scripts) "
        "SELECT script_name, split_part(trim(item), ' AS ', 1) AS field, split_part(trim(item), ' AS ', 2) AS alias FROM i",
    ),
    "target_date_field": with_views(
        ["scripts"],
        "SELECT script_name, regexp_extract(script_content, regexp_extract(script_content, 'AND ([\\w.]+) <', 1) || ' AS (\\w+)', 1) AS date_field FROM scripts",
    ),
    "insert_target": with_views(
        ["scripts"],
        "SELECT script_name, split_part(script_content, ' ', 3) AS insert_target, 'DELETE FROM ' || split_part(script_content, ' ', 3) "
        "|| chr(10) || 'WHERE summary_date >= ''{{ start_date }}''' || chr(10) || '  AND summary_date < ''{{ end_date }}'';' AS window_delete FROM scripts",
    ),
    "ddl_from_metadata": with_views(
        ["nodes", "columns"],
        ", l AS (SELECT table_name, string_agg('`' || en_name || '` ' || CASE data_type WHEN 'bigint' THEN 'BIGINT' WHEN 'varchar(20)' THEN 'STRING' "
        "WHEN 'numeric(18,2)' THEN 'DECIMAL(18,2)' ELSE 'DATE' END || CASE WHEN name IS NOT NULL THEN ' COMMENT ''' || name || '''' ELSE '' END, "
        "',' || chr(10) || '  ' ORDER BY column_id) AS body, string_agg(CASE WHEN is_pk THEN en_name END, ', ' ORDER BY en_name) AS pk "
        "FROM columns GROUP BY table_name) "
        "SELECT table_name, 'CREATE TABLE IF NOT EXISTS `' || CASE WHEN label = 'DataResource' THEN 'ods' ELSE 'ads' END || '`.`' || table_name || '` (' "
        "|| chr(10) || '  ' || body || ',' || chr(10) || '  `create_time` TIMESTAMP_NTZ,' || chr(10) || '  `update_time` TIMESTAMP_NTZ' || chr(10) "
        "|| ') USING parquet COMMENT ''' || replace(name, '''', '\\''') || '''' AS ddl, pk FROM l JOIN nodes ON en_name = table_name",
    ),
}
