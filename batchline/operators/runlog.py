"""Statistics and reports over task runs.

``task_runs`` has ``dag_id, run_id, task_id, script_type, state, start_date, end_date,
try_number``; times are naive UTC. All statistics are per run and use partial aggregates.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchline.functions.periods import elapsed_seconds, hours_text, local_time_text, minutes_text
from batchline.operators.numbers import numbered

# States, the mark of a script task and how many slowest tasks are shown.
FAILED_STATES = ("failed", "upstream_failed")
SCRIPT_MARK = "-TO-"
TOP_TASKS = 5

RUN = ("dag_id", "run_id")


def match_runs(requests: DataFrame, runs: DataFrame, strict: bool = False) -> DataFrame:
    """The run of each request ``(request_id, dag_id, run_id, exec_date)``.

    The run of that id, else the latest run (by id, among those of the same date), else
    nothing: ``matched_run`` and ``match_method`` are null, or with ``strict`` an error.
    """
    exact = runs.select("dag_id", "run_id", F.col("run_id").alias("by_id")).distinct()
    dated = runs.groupBy("dag_id", F.col("execution_date").alias("exec_date")).agg(
        F.max("run_id").alias("by_date")
    )
    found = requests.join(exact, ["dag_id", "run_id"], "left").join(
        dated, ["dag_id", "exec_date"], "left"
    )
    matched = F.coalesce("by_id", "by_date")
    if strict:
        missing = F.concat(F.lit("no run for request "), F.col("request_id").cast("string"))
        matched = F.coalesce(matched, F.raise_error(missing).cast("string"))
    method = F.when(F.col("by_id").isNotNull(), "run_id").when(F.col("by_date").isNotNull(), "exec_date")
    return found.select(
        *requests.columns, matched.alias("matched_run"), method.alias("match_method")
    )


def run_counts(task_runs: DataFrame) -> DataFrame:
    """Tasks per run by state, and script tasks."""
    def in_state(state: str) -> Column:
        return F.count_if(F.col("state") == state)

    return task_runs.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        in_state("success").alias("success_count"),
        in_state("failed").alias("fail_count"),
        in_state("skipped").alias("skipped_count"),
        in_state("upstream_failed").alias("upstream_failed_count"),
        F.count_if(F.col("task_id").contains(SCRIPT_MARK)).alias("script_task_count"),
    )


def top_durations(task_runs: DataFrame, top: int = TOP_TASKS) -> DataFrame:
    """The slowest finished tasks per run, ranked; ties by task id.

    The rank limit applies before the shuffle, so a run's size does not matter.
    """
    seconds = elapsed_seconds(F.col("start_date"), F.col("end_date"))
    slowest = Window.partitionBy(*RUN).orderBy(F.desc("duration"), "task_id", "state")
    timed = task_runs.select(*RUN, "task_id", "state", seconds.alias("duration"))
    ranked = timed.filter("duration IS NOT NULL").withColumn("place", F.row_number().over(slowest))
    return ranked.filter(F.col("place") <= top)


def failed_tasks(task_runs: DataFrame) -> DataFrame:
    """Failed tasks with their tries, and their duration where both ends are known."""
    seconds = elapsed_seconds(F.col("start_date"), F.col("end_date"))
    failed = task_runs.filter(F.col("state").isin(*FAILED_STATES))
    return failed.select(*RUN, "task_id", "state", "try_number", seconds.alias("duration"))


def percent(part: Column, whole: Column) -> Column:
    """Two decimals; 0 when there is nothing."""
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), 2)


def success_rate(task_runs: DataFrame) -> DataFrame:
    """Percent of successful tasks per run."""
    counts = run_counts(task_runs)
    return counts.select(*RUN, percent(F.col("success_count"), F.col("total_tasks")).alias("success_rate"))


def type_counts(task_runs: DataFrame) -> DataFrame:
    """Tasks per run and script type."""
    return task_runs.groupBy(*RUN, "script_type").agg(F.count(F.lit(1)).alias("tasks"))


def run_spans(task_runs: DataFrame) -> DataFrame:
    """First start and last end per run; open runs have no end."""
    open_ended = F.some(F.col("end_date").isNull())
    return task_runs.groupBy(*RUN).agg(
        F.min("start_date").alias("started"),
        F.when(~open_ended, F.max("end_date")).alias("ended"),
    )


def report_lines(task_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """The report of each run as ordered lines: ``dag_id, run_id, section, place, item, line``.

    ``runs`` has ``dag_id, run_id, exec_date, status, started, ended``. Sorting the lines of
    a run by ``section, item, place`` gives its report; no run is gathered into one row.
    ``item`` is the failed task a line belongs to; failed tasks are numbered by task id.
    """
    # Headings and line texts of the report.
    heading = "========== 脚本执行报告 =========="
    state_heading = "--- 任务状态统计 ---"
    type_heading = "--- 任务类型统计 ---"
    time_heading = "--- 执行时间统计 ---"
    top_heading = "--- 执行时间最长的任务 ---"
    failed_heading = "--- 失败任务详情 ---"
    summary_heading = "--- 总结 ---"
    closing = "========== 报告结束 =========="
    all_good = "所有脚本执行成功完成！"
    some_failed = "脚本执行过程中出现失败。有 %d 个任务失败。"

    head = runs.join(run_counts(task_runs), list(RUN), "left").fillna(
        0, ["total_tasks", "success_count", "fail_count", "skipped_count",
            "upstream_failed_count", "script_task_count"]
    )
    seconds = elapsed_seconds(F.col("started"), F.col("ended"))
    ending = (
        F.when(F.col("status") == "success", all_good)
        .when(F.col("status") == "failed", F.format_string(some_failed, "fail_count"))
        .otherwise(F.format_string("当前状态: %s", "status"))
    )
    rate = percent(F.col("success_count"), F.col("total_tasks"))
    fixed = [
        (1, 0, F.lit(heading)),
        (1, 1, F.format_string("执行日期: %s", F.date_format("exec_date", "yyyy-MM-dd"))),
        (1, 2, F.format_string("DAG ID: %s", "dag_id")),
        (1, 3, F.format_string("Run ID: %s", "run_id")),
        (1, 4, F.format_string("状态: %s", "status")),
        (1, 5, F.format_string("总任务数: %d", "total_tasks")),
        (2, 0, F.lit(state_heading)),
        (2, 1, F.format_string("成功任务: %d 个", "success_count")),
        (2, 2, F.format_string("失败任务: %d 个", "fail_count")),
        (2, 3, F.format_string("跳过任务: %d 个", "skipped_count")),
        (2, 4, F.format_string("上游失败任务: %d 个", "upstream_failed_count")),
        (3, 0, F.lit(type_heading)),
        (3, 1, F.format_string("脚本执行任务: %d 个", "script_task_count")),
        (4, 0, F.lit(time_heading)),
        (4, 1, F.concat(F.lit("总执行时间: "), hours_text(seconds))),
        (4, 2, F.concat(F.lit("开始时间(北京时间): "), local_time_text(F.col("started")))),
        (4, 3, F.concat(F.lit("结束时间(北京时间): "), local_time_text(F.col("ended")))),
        (7, 0, F.lit(summary_heading)),
        (7, 1, F.format_string("任务成功率: %.2f%%", rate)),
        (7, 2, ending),
        (8, 0, F.lit(closing)),
    ]
    of_runs = head.select(*RUN, F.inline(_lines(fixed)))
    slow = top_durations(task_runs).select(
        *RUN, F.lit(5).alias("section"), "place", F.lit("").alias("item"),
        F.concat(
            F.format_string("%d. %s: ", "place", "task_id"), minutes_text(F.col("duration")),
            F.format_string(" (%s)", "state"),
        ).alias("line"),
    )
    details = F.array(
        F.format_string("%d. 任务ID: %s", "number", "task_id"),
        F.format_string("   状态: %s", "state"),
        F.concat(F.lit("   尝试次数: "), F.coalesce(F.col("try_number").cast("string"), F.lit("N/A"))),
        F.concat(F.lit("   执行时间: "), minutes_text(F.col("duration"))),
    )
    failed = numbered(failed_tasks(task_runs), list(RUN), ["task_id", "try_number", "state", "duration"]).select(
        *RUN, F.lit(6).alias("section"), F.col("task_id").alias("item"), F.posexplode(details).alias("at", "line")
    ).select(*RUN, "section", (F.col("at") + 1).alias("place"), "item", "line")
    return reduce(
        DataFrame.unionByName,
        [
            of_runs, slow, _headed(_finished(task_runs), 5, top_heading),
            failed, _headed(head.filter("fail_count + upstream_failed_count > 0"), 6, failed_heading),
        ],
    )


def _lines(fixed: list[tuple[int, int, Column]]) -> Column:
    """Lines that every report has, as an array of structs."""
    return F.array(
        *[
            F.struct(
                F.lit(section).alias("section"), F.lit(place).alias("place"),
                F.lit("").alias("item"), text.alias("line"),
            )
            for section, place, text in fixed
        ]
    )


def _finished(task_runs: DataFrame) -> DataFrame:
    """Runs with a task whose duration is known: a partial aggregate, without a rank."""
    known = F.count_if(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    return task_runs.groupBy(*RUN).agg(known.alias("known")).filter("known > 0")


def _headed(lines: DataFrame, section: int, text: str) -> DataFrame:
    """The heading of a section, for runs that have lines in it: one row each."""
    return lines.select(
        *RUN, F.lit(section).alias("section"), F.lit(0).alias("place"), F.lit("").alias("item"),
        F.lit(text).alias("line"),
    )


def chain_report_lines(results: DataFrame, generated: datetime | None = None) -> DataFrame:
    """Counts of a chain of scripts by outcome and type, then one line per script.

    ``generated`` is the clock reading that the report names as its time; now by default.
    ``results`` has ``exec_date, step, script_name, target_table, script_type, success``;
    lines sort as in ``report_lines``.
    """
    # Headings and line texts of the report.
    totals = results.groupBy("exec_date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("good")
    )
    rate = percent(F.col("good"), F.col("total"))
    fixed = [
        (1, 0, F.lit("========== 脚本执行报告 ==========")),
        (1, 1, F.format_string("执行日期: %s", F.date_format("exec_date", "yyyy-MM-dd"))),
        (1, 2, F.lit(f"报告生成时间: {generated or datetime.now():%Y-%m-%d %H:%M:%S}")),
        (1, 3, F.format_string("总脚本数: %d", "total")),
        (1, 4, F.format_string("成功数: %d", "good")),
        (1, 5, F.format_string("失败数: %d", F.col("total") - F.col("good"))),
        (1, 6, F.format_string("成功率: %.2f%%", rate)),
        (2, 0, F.lit("--- 脚本类型统计 ---")),
        (3, 0, F.lit("--- 执行详情 ---")),
        (4, 0, F.lit("========== 报告结束 ==========")),
    ]
    by_type = results.groupBy("exec_date", "script_type").agg(F.count(F.lit(1)).alias("n"))
    kind = F.coalesce("script_type", F.lit("None"))
    types = by_type.select(
        "exec_date", F.lit(2).alias("section"), F.lit(1).alias("place"), kind.alias("item"),
        F.format_string("%s: %d 个", kind, "n").alias("line"),
    )
    outcome = F.when(F.col("success"), "✓ 成功").otherwise("✗ 失败")
    scripts = results.select(
        "exec_date", F.lit(3).alias("section"), F.col("step").alias("place"), F.lit("").alias("item"),
        F.format_string(
            "%d. %s -> %s (%s): %s", "step", "script_name", "target_table", kind, outcome
        ).alias("line"),
    )
    return totals.select("exec_date", F.inline(_lines(fixed))).unionByName(types).unionByName(scripts)


def fold_task_log(events: DataFrame) -> DataFrame:
    """The task log from append-only events.

    ``events`` has ``exec_date`` (a date or its text), ``target_table, script_name``, a
    ``kind`` of ``start`` or ``end``, the ``event_time``, the order ``written`` in, and for
    ends ``success`` and ``duration``. The last event of a kind wins, as an update would.
    """
    def last(kind: str, *values: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct("written", *values)))

    keyed = events.withColumn("exec_date", F.to_date("exec_date"))
    folded = keyed.groupBy("exec_date", "target_table", "script_name").agg(
        last("start", "event_time").alias("start"),
        last("end", "event_time", "duration", "success").alias("end"),
    )
    return folded.select(
        "exec_date", "target_table", "script_name",
        F.col("start.event_time").alias("exec_start_time"), F.col("end.event_time").alias("exec_end_time"),
        F.col("end.duration").alias("exec_duration"), F.col("end.success").alias("exec_result"),
    )
