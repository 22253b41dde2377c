"""Documents and run logs derived from orders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.fixtures import view, with_views
from batchline.operators import documents, runlog
from batchline.queries import scratch_table
from batchline.scratch import new_dir
from batchline.sinks import writes
from batchline.sinks.retention import delete_old_plans
from batchline.sinks.tables import create_table
from batchline.streaming.tasklog import fold_stream


def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order date and DAG: the plan valid three days later."""
    plans = view(spark, sf_dir, "exec_plans")
    requests = plans.select("dag_id", F.date_add("exec_date", 3).alias("ds")).distinct()
    return documents.latest_as_of(requests, plans)


def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "exec_plans").select("run_id", documents.plan_valid(F.col("plan")).alias("valid"))


def keep_latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = documents.keep_latest(view(spark, sf_dir, "exec_plans"))
    return kept.select("dag_id", "run_id", "exec_date", "create_time")


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan log with every plan in three rows, and plans of every seventh order saved twice."""
    plans = view(spark, sf_dir, "exec_plans")
    twice = F.when(F.substring("run_id", 2, 20).cast("bigint") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    saved = plans.withColumn("again", F.explode(twice)).withColumn("part", F.explode(F.array(*map(F.lit, range(3)))))
    return saved.withColumn("create_time", F.col("create_time") + F.make_dt_interval(F.lit(0), F.col("again"))).drop("again")


def asof_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``asof_latest``, over plans of several rows of which some were saved twice."""
    plans = _parted(spark, sf_dir)
    requests = plans.select("dag_id", F.date_add("exec_date", 3).alias("ds")).distinct()
    return documents.latest_as_of(requests, plans).select("dag_id", "ds", "exec_date", "run_id", "part")


def keep_latest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.keep_latest(_parted(spark, sf_dir)).select("dag_id", "run_id", "exec_date", "create_time", "part")


def retention_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan log stored by month; old plans are deleted, twice."""
    plans = view(spark, sf_dir, "exec_plans").withColumn("month", F.trunc("exec_date", "month"))
    target = scratch_table(spark, "plans")
    create_table(spark, target, plans.schema, ["month"])
    writes.append(plans, target)
    for _ in range(2):
        delete_old_plans(spark, target)
    return spark.table(target).select("dag_id", "run_id", "exec_date", "create_time")


def run_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by day; orders ask for them by id, by an id that is too new, or for a later day."""
    tasks = view(spark, sf_dir, "task_runs")
    named = F.concat_ws("_", "run_id", "execution_date")
    runs = tasks.select("dag_id", named.alias("run_id"), "execution_date").distinct()
    requests = tasks.select(
        F.col("task_id").alias("request_id"), "dag_id",
        F.when(F.length("task_id") % 2 == 0, named).otherwise("run_x").alias("run_id"),
        F.when(F.col("try_number") < 3, F.col("execution_date")).otherwise(F.date_add("execution_date", 10000)).alias("exec_date"),
    )
    return runlog.match_runs(requests, runs).select("request_id", "matched_run", "match_method")


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_counts(view(spark, sf_dir, "task_runs"))


def top_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.top_durations(view(spark, sf_dir, "task_runs"))


def failed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.failed_tasks(view(spark, sf_dir, "task_runs"))


def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.success_rate(view(spark, sf_dir, "task_runs"))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.type_counts(view(spark, sf_dir, "task_runs"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, "task_runs")
    runs = tasks.groupBy("dag_id", "run_id").agg(
        F.max("execution_date").alias("exec_date"), F.min("start_date").alias("started"), F.max("end_date").alias("ended")
    ).withColumn(
        "status", F.when(F.col("run_id").endswith("0"), "success").when(F.col("run_id").endswith("1"), "running").otherwise("failed")
    )
    return runlog.report_lines(tasks, runs)


def chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = view(spark, sf_dir, "plan_scripts").select(
        "exec_date", F.substring("target_table", 2, 20).cast("bigint").alias("step"), "script_name", "target_table",
        F.when(F.col("script_name").endswith(".sql"), "sql").otherwise("python_script").alias("script_type"),
        F.col("source_b").isNull().alias("success"),
    )
    return runlog.chain_report_lines(results, datetime(2024, 1, 2, 3, 4, 5))


def _task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end events of every try of every task, each try later than the one before."""
    tasks = view(spark, sf_dir, "task_runs").withColumn("attempt", F.explode(F.sequence(F.lit(1), "try_number")))
    shift = F.make_dt_interval(F.col("attempt"))
    seconds = F.timestamp_diff("SECOND", F.col("start_date"), F.col("end_date")).cast("double")
    common = ["attempt", F.col("run_id").alias("target_table"), F.col("task_id").alias("script_name")]
    starts = tasks.select(
        F.date_format("execution_date", "yyyy-MM-dd").alias("exec_date"), *common, F.lit("start").alias("kind"),
        (F.col("start_date") + shift).alias("event_time"),
        F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("double").alias("duration"),
    )
    ends = tasks.filter("end_date IS NOT NULL").select(
        F.col("execution_date").cast("string").alias("exec_date"), *common, F.lit("end").alias("kind"),
        (F.col("end_date") + shift).alias("event_time"),
        ((F.col("state") == "success") & (F.col("attempt") == F.col("try_number"))).alias("success"), seconds.alias("duration"),
    )
    return starts.unionByName(ends).withColumnRenamed("attempt", "written")


def run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.fold_task_log(_task_events(spark, sf_dir))


def run_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as files of a stream, dealt by hash, so that ends come before their starts and
    early tries after late ones; a second run over the same folder then finds the rest. A batch has a
    file for every core, so that neither the writing of the events nor their reading waits for one task."""
    events, folder = new_dir(spark, "events"), new_dir(spark, "task_log")
    files = spark.sparkContext.defaultParallelism
    dealt = _task_events(spark, sf_dir).withColumn("deal", F.pmod(F.xxhash64("target_table", "script_name", "kind", "written"), F.lit(4)))
    for half in (0, 1):
        now = dealt.filter((F.col("deal") / 2).cast("int") == half)
        now.repartition(2 * files, "deal", "target_table", "script_name").drop("deal").write.mode("append").parquet(events)
        log = fold_stream(spark, events, folder, files_per_batch=files)
    return log


QUERIES = {
    "asof_latest": asof_latest,
    "asof_parts": asof_parts,
    "json_validate": json_validate,
    "keep_latest_parts": keep_latest_parts,
    "keep_latest_n": keep_latest_n,
    "retention_rewrite": retention_rewrite,
    "run_match": run_match,
    "run_counts": run_counts,
    "top_durations": top_durations,
    "failed_tasks": failed_tasks,
    "success_rate": success_rate,
    "type_counts": type_counts,
    "report_lines": report_lines,
    "chain_report": chain_report,
    "run_fold": run_fold,
    "run_fold_stream": run_fold_stream,
}

_COUNTS = (
    "SELECT dag_id, run_id, count(*) AS total_tasks, count_if(state = 'success') AS success_count, count_if(state = 'failed') AS fail_count, "
    "count_if(state = 'skipped') AS skipped_count, count_if(state = 'upstream_failed') AS upstream_failed_count, "
    "count_if(contains(task_id, '-TO-')) AS script_task_count FROM task_runs GROUP BY dag_id, run_id"
)
_SECONDS = "CAST(date_diff('second', start_date, end_date) AS double)"
_TOP = (
    f"SELECT dag_id, run_id, task_id, state, {_SECONDS} AS duration, CAST(row_number() OVER (PARTITION BY dag_id, run_id "
    f"ORDER BY {_SECONDS} DESC, task_id) AS int) AS place FROM task_runs WHERE end_date IS NOT NULL QUALIFY place <= 5"
)
_FAILED = f"SELECT dag_id, run_id, task_id, state, try_number, {_SECONDS} AS duration FROM task_runs WHERE state IN ('failed', 'upstream_failed')"


def _minutes(n: str) -> str:
    whole = f"CAST({n} AS bigint)"
    return f"coalesce({whole} // 60 || '分钟 ' || {whole} % 60 || '秒', 'N/A')"


def _local(t: str) -> str:
    return f"coalesce(strftime({t} + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S'), 'N/A')"


# Headings and line texts of the reports.
_FIXED = [
    (1, 0, "'========== 脚本执行报告 =========='"),
    (1, 1, "'执行日期: ' || CAST(exec_date AS string)"),
    (1, 2, "'DAG ID: ' || dag_id"),
    (1, 3, "'Run ID: ' || run_id"),
    (1, 4, "'状态: ' || status"),
    (1, 5, "'总任务数: ' || total_tasks"),
    (2, 0, "'--- 任务状态统计 ---'"),
    (2, 1, "'成功任务: ' || success_count || ' 个'"),
    (2, 2, "'失败任务: ' || fail_count || ' 个'"),
    (2, 3, "'跳过任务: ' || skipped_count || ' 个'"),
    (2, 4, "'上游失败任务: ' || upstream_failed_count || ' 个'"),
    (3, 0, "'--- 任务类型统计 ---'"),
    (3, 1, "'脚本执行任务: ' || script_task_count || ' 个'"),
    (4, 0, "'--- 执行时间统计 ---'"),
    (4, 1, "'总执行时间: ' || (n // 3600) || '小时 ' || (n % 3600 // 60) || '分钟 ' || (n % 60) || '秒'"),
    (4, 2, f"'开始时间(北京时间): ' || {_local('started')}"),
    (4, 3, f"'结束时间(北京时间): ' || {_local('ended')}"),
    (7, 0, "'--- 总结 ---'"),
    (7, 1, "format('任务成功率: {:.2f}%', round(success_count * 100.0 / total_tasks, 2))"),
    (7, 2, "CASE status WHEN 'success' THEN '所有脚本执行成功完成！' WHEN 'failed' THEN '脚本执行过程中出现失败。有 ' || fail_count || ' 个任务失败。' ELSE '当前状态: ' || status END"),
    (8, 0, "'========== 报告结束 =========='"),
]
_REPORT = (
    f", counts AS ({_COUNTS}), runs AS (SELECT dag_id, run_id, max(execution_date) AS exec_date, min(start_date) AS started, max(end_date) AS ended, "
    "CASE WHEN run_id LIKE '%0' THEN 'success' WHEN run_id LIKE '%1' THEN 'running' ELSE 'failed' END AS status FROM task_runs GROUP BY dag_id, run_id), "
    "head AS (SELECT *, date_diff('second', started, ended) AS n FROM runs JOIN counts USING (dag_id, run_id)), "
    f"slow AS ({_TOP}), bad AS ({_FAILED}) "
    + " UNION ALL ".join(f"SELECT dag_id, run_id, {s} AS section, {p} AS place, '' AS item, {t} AS line FROM head" for s, p, t in _FIXED)
    + " UNION ALL SELECT DISTINCT dag_id, run_id, 5, 0, '', '--- 执行时间最长的任务 ---' FROM slow "
    f"UNION ALL SELECT dag_id, run_id, 5, place, '', place || '. ' || task_id || ': ' || {_minutes('duration')} || ' (' || state || ')' FROM slow "
    "UNION ALL SELECT DISTINCT dag_id, run_id, 6, 0, '', '--- 失败任务详情 ---' FROM bad "
    "UNION ALL SELECT dag_id, run_id, 6, 1, task_id, row_number() OVER (PARTITION BY dag_id, run_id ORDER BY task_id, try_number, state, duration) || '. 任务ID: ' || task_id FROM bad "
    "UNION ALL SELECT dag_id, run_id, 6, 2, task_id, '   状态: ' || state FROM bad "
    "UNION ALL SELECT dag_id, run_id, 6, 3, task_id, '   尝试次数: ' || try_number FROM bad "
    f"UNION ALL SELECT dag_id, run_id, 6, 4, task_id, '   执行时间: ' || {_minutes('duration')} FROM bad"
)
# Headings and line texts of the reports.
_CHAIN = (
    ", r AS (SELECT exec_date, CAST(substr(target_table, 2) AS bigint) AS step, script_name, target_table, "
    "CASE WHEN script_name LIKE '%.sql' THEN 'sql' ELSE 'python_script' END AS script_type, source_b IS NULL AS success FROM plan_scripts), "
    "t AS (SELECT exec_date, count(*) AS total, count_if(success) AS good FROM r GROUP BY exec_date) "
    + " UNION ALL ".join(
        f"SELECT exec_date, {s} AS section, CAST({p} AS bigint) AS place, '' AS item, {line} AS line FROM t"
        for s, p, line in [
            (1, 0, "'========== 脚本执行报告 =========='"),
            (1, 1, "'执行日期: ' || CAST(exec_date AS string)"),
            (1, 2, "'报告生成时间: 2024-01-02 03:04:05'"),
            (1, 3, "'总脚本数: ' || total"),
            (1, 4, "'成功数: ' || good"),
            (1, 5, "'失败数: ' || (total - good)"),
            (1, 6, "format('成功率: {:.2f}%', round(good * 100.0 / total, 2))"),
            (2, 0, "'--- 脚本类型统计 ---'"),
            (3, 0, "'--- 执行详情 ---'"),
            (4, 0, "'========== 报告结束 =========='"),
        ]
    )
    + " UNION ALL SELECT exec_date, 2, 1, script_type, script_type || ': ' || count(*) || ' 个' FROM r GROUP BY exec_date, script_type "
    "UNION ALL SELECT exec_date, 3, step, '', step || '. ' || script_name || ' -> ' || target_table || ' (' || script_type || '): ' "
    "|| CASE WHEN success THEN '✓ 成功' ELSE '✗ 失败' END FROM r"
)

ORACLE = {
    "asof_latest": with_views(
        ["exec_plans"],
        ", days AS (SELECT * FROM exec_plans QUALIFY row_number() OVER (PARTITION BY dag_id, exec_date ORDER BY logical_date DESC, run_id DESC) = 1), "
        "asked AS (SELECT DISTINCT dag_id, CAST(exec_date + INTERVAL 3 DAY AS date) AS ds FROM exec_plans) "
        "SELECT a.dag_id, a.ds, d.exec_date, d.logical_date, d.run_id, d.plan FROM asked a "
        "ASOF LEFT JOIN days d ON a.dag_id = d.dag_id AND a.ds >= d.exec_date",
    ),
    "asof_parts": with_views(
        ["exec_plans"],
        ", days AS (SELECT * FROM exec_plans QUALIFY row_number() OVER (PARTITION BY dag_id, exec_date ORDER BY logical_date DESC, run_id DESC) = 1), "
        "asked AS (SELECT DISTINCT dag_id, CAST(exec_date + INTERVAL 3 DAY AS date) AS ds FROM exec_plans) "
        "SELECT a.dag_id, a.ds, d.exec_date, d.run_id, CAST(part AS int) AS part FROM asked a "
        "ASOF LEFT JOIN days d ON a.dag_id = d.dag_id AND a.ds >= d.exec_date CROSS JOIN range(3) AS p(part)",
    ),
    "keep_latest_parts": with_views(
        ["exec_plans"],
        ", saved AS (SELECT p.* REPLACE (create_time + INTERVAL 1 HOUR * again AS create_time) FROM exec_plans p, range(2) AS a(again) "
        "WHERE again = 0 OR CAST(substr(run_id, 2) AS bigint) % 7 = 0), "
        "kept AS (SELECT dag_id, run_id, exec_date, create_time FROM saved "
        "QUALIFY row_number() OVER (PARTITION BY dag_id, exec_date ORDER BY create_time DESC, run_id) <= 5) "
        "SELECT kept.*, CAST(part AS int) AS part FROM kept, range(3) AS p(part)",
    ),
    "json_validate": with_views(
        ["exec_plans"],
        "SELECT run_id, contains(plan, '\"exec_date\"') AND NOT contains(plan, '\"bad\"') AS valid FROM exec_plans",
    ),
    "keep_latest_n": with_views(
        ["exec_plans"],
        "SELECT dag_id, run_id, exec_date, create_time FROM exec_plans "
        "QUALIFY row_number() OVER (PARTITION BY dag_id, exec_date ORDER BY create_time DESC, run_id) <= 5",
    ),
    "run_match": with_views(
        ["task_runs"],
        ", runs AS (SELECT DISTINCT dag_id, run_id || '_' || CAST(execution_date AS string) AS run_id, execution_date FROM task_runs), "
        "q AS (SELECT task_id AS request_id, CASE WHEN length(task_id) % 2 = 0 THEN run_id || '_' || CAST(execution_date AS string) ELSE 'run_x' END AS run_id, "
        "CASE WHEN try_number < 3 THEN execution_date ELSE execution_date + 10000 END AS exec_date FROM task_runs), "
        "d AS (SELECT execution_date, max(run_id) AS by_date FROM runs GROUP BY execution_date) "
        "SELECT request_id, coalesce(r.run_id, by_date) AS matched_run, CASE WHEN r.run_id IS NOT NULL THEN 'run_id' WHEN by_date IS NOT NULL THEN 'exec_date' END AS match_method "
        "FROM q LEFT JOIN runs r ON r.run_id = q.run_id LEFT JOIN d ON d.execution_date = q.exec_date",
    ),
    "run_counts": with_views(["task_runs"], _COUNTS),
    "top_durations": with_views(["task_runs"], _TOP),
    "failed_tasks": with_views(["task_runs"], _FAILED),
    "success_rate": with_views(
        ["task_runs"], f", c AS ({_COUNTS}) SELECT dag_id, run_id, round(success_count * 100.0 / total_tasks, 2) AS success_rate FROM c"
    ),
    "type_counts": with_views(["task_runs"], "SELECT dag_id, run_id, script_type, count(*) AS tasks FROM task_runs GROUP BY ALL"),
    "report_lines": with_views(["task_runs"], _REPORT),
    "chain_report": with_views(["plan_scripts"], _CHAIN),
    "run_fold": with_views(
        ["task_runs"],
        "SELECT execution_date AS exec_date, run_id AS target_table, task_id AS script_name, "
        "start_date + INTERVAL 1 DAY * try_number AS exec_start_time, end_date + INTERVAL 1 DAY * try_number AS exec_end_time, "
        f"{_SECONDS} AS exec_duration, CASE WHEN end_date IS NOT NULL THEN state = 'success' END AS exec_result FROM task_runs",
    ),
}

ORACLE["run_fold_stream"] = ORACLE["run_fold"]
ORACLE["retention_rewrite"] = ORACLE["keep_latest_n"]
