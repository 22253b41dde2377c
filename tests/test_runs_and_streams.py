from __future__ import annotations

import os
import random
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from batchline.operators import documents, runlog
from batchline.queries import scratch_table
from batchline.scratch import new_dir
from batchline.sinks.tables import create_table
from batchline.streaming import ingest as stream
from batchline.streaming import tasklog


@pytest.mark.parametrize(
    ("plan", "valid"),
    [
        ('{"exec_date": "2024-01-01"}', True),
        ('{"exec_date": null, "scripts": []}', True),
        ('{"scripts": []}', False),
        ('{"exec_date": 1, "scripts": {}}', False),
        ('{"exec_date": 1, "model_scripts": null}', False),
        ('{"exec_date": 1, "resource_scripts": [1, "a"], "scripts": []}', True),
        ("[]", False), ("{}", False), ("not json", False), (None, False),
    ],
)
def test_plan_valid(spark, plan, valid):
    df = spark.createDataFrame([(plan,)], "plan string")
    assert df.select(documents.plan_valid(F.col("plan"))).head()[0] is valid


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_plan_has_one_shape_at_every_size(spark, n):
    scripts = spark.range(n).selectExpr(
        "DATE'2024-01-01' AS exec_date", "concat('s', id) AS script_id", "if(id % 2 = 0, 'DataModel', 'DataResource') AS target_table_label", "CAST(id % 3 AS int) AS level"
    )
    needs = spark.range(n).selectExpr("DATE'2024-01-01' AS exec_date", "concat('s', id) AS script_id", "'hub' AS depends_on").union(
        spark.range(n * 3 // 5).selectExpr("DATE'2024-01-01'", "'s0'", "concat('s', id + 1)")
    )
    plans = documents.pack_plans(scripts, needs)
    assert plans.filter(~documents.plan_valid(F.col("plan"))).count() == 0
    lists = (
        "scripts array<struct<script_id:string>>, script_dependencies map<string, array<string>>, resource_scripts array<string>, "
        "model_scripts array<string>, script_count int, wait_count int"
    )
    rows = [(r["part"], r["script_id"], r["p"]) for r in plans.select("part", "script_id", F.from_json("plan", lists).alias("p")).collect()]
    heads = [(p["script_count"], p["wait_count"]) for part, _, p in rows if part == "plan"]
    assert heads == ([(n, n + n * 3 // 5)] if n else [])
    assert sorted((i, [s["script_id"] for s in p["scripts"]]) for part, i, p in rows if part == "script") == sorted((f"s{i}", [f"s{i}"]) for i in range(n))
    for field, rest in [("model_scripts", 0), ("resource_scripts", 1)]:
        assert sorted(i for part, _, p in rows if part == "script" for i in p[field]) == sorted(f"s{i}" for i in range(n) if i % 2 == rest)
    pairs = sorted((k, v) for part, _, p in rows if part == "wait" for k, vs in p["script_dependencies"].items() for v in vs)
    assert pairs == sorted([(f"s{i}", "hub") for i in range(n)] + [("s0", f"s{i + 1}") for i in range(n * 3 // 5)])
    order = documents.execution_order(plans).orderBy("place").collect()
    assert [r["script_id"] for r in order] == sorted((f"s{i}" for i in range(n)), key=lambda s: (int(s[1:]) % 3, s))
    assert [r["place"] for r in order] == list(range(1, n + 1))


def test_plan_of_awkward_rows(spark):
    scripts = spark.createDataFrame(
        [(date(2024, 1, 1), "a", None, None), (date(2024, 1, 1), "a", "DataModel", 2), (date(2024, 1, 1), "b", None, None), (date(2024, 1, 1), None, "DataModel", 0)],
        "exec_date date, script_id string, target_table_label string, level int",
    )
    needs = spark.createDataFrame([(date(2024, 1, 1), "a", None), (date(2024, 1, 2), "c", "a")], "exec_date date, script_id string, depends_on string")
    plans = documents.pack_plans(scripts, needs)
    assert {(r["exec_date"].day, r["part"], r["script_id"]) for r in plans.collect()} == {
        (1, "plan", None), (1, "script", "a"), (1, "script", "b"), (1, "script", None), (2, "plan", None), (2, "wait", "c"),
    }
    assert [(r["script_id"], r["place"]) for r in documents.execution_order(plans).orderBy("place").collect()] == [("b", 1), (None, 2), ("a", 3)]


def test_latest_for_one_date(spark):
    plans = spark.createDataFrame(
        [("d", "r1", datetime(2024, 1, 1), date(2024, 1, 1), "a"), ("d", "r2", datetime(2024, 1, 1, 5), date(2024, 1, 1), "b"), ("d", "r3", datetime(2024, 1, 9), date(2024, 1, 3), "c")],
        "dag_id string, run_id string, logical_date timestamp_ntz, exec_date date, plan string",
    )
    assert documents.latest_for(plans, "d", "2024-01-02").head()["plan"] == "b"
    assert documents.latest_for(plans, "d", "2023-12-31").head() is None
    asked = spark.createDataFrame([("d", date(2024, 1, 2)), ("d", date(2024, 1, 3)), ("d", date(2023, 1, 1)), ("e", date(2024, 1, 2))], "dag_id string, ds date")
    got = {(r["dag_id"], r["ds"].isoformat()): r["plan"] for r in documents.latest_as_of(asked, plans).collect()}
    assert got == {("d", "2024-01-02"): "b", ("d", "2024-01-03"): "c", ("d", "2023-01-01"): None, ("e", "2024-01-02"): None}
    assert documents.keep_latest(plans.withColumn("create_time", F.col("logical_date")), 0).count() == 3


def test_strict_run_match(spark):
    runs = spark.createDataFrame([("d", "r", date(2024, 1, 1))], "dag_id string, run_id string, execution_date date")
    asked = spark.createDataFrame([(1, "d", "x", date(2024, 1, 2))], "request_id int, dag_id string, run_id string, exec_date date")
    assert runlog.match_runs(asked, runs).head()["matched_run"] is None
    with pytest.raises(Exception, match="no run for request 1"):
        runlog.match_runs(asked, runs, strict=True).collect()


def test_rate_of_nothing(spark):
    assert spark.range(1).select(runlog.percent(F.lit(0), F.lit(0)), runlog.percent(F.lit(1), F.lit(3))).head()[:] == (0.0, 33.33)


def test_report_of_a_run(spark):
    tasks = spark.createDataFrame(
        [
            ("d", "r", "a-TO-b", "sql", "success", datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 0, 2, 5), 1),
            ("d", "r", "c", "sql", "failed", datetime(2024, 1, 1, 0), None, 2),
        ],
        "dag_id string, run_id string, task_id string, script_type string, state string, start_date timestamp_ntz, end_date timestamp_ntz, try_number int",
    )
    runs = runlog.run_spans(tasks).withColumns({"exec_date": F.lit(date(2024, 1, 1)), "status": F.lit("failed")})
    lines = [r["line"] for r in runlog.report_lines(tasks, runs).orderBy("section", "item", "place").collect()]
    # Headings and line texts of the report.
    assert lines == [
        "========== 脚本执行报告 ==========", "执行日期: 2024-01-01", "DAG ID: d", "Run ID: r", "状态: failed", "总任务数: 2",
        "--- 任务状态统计 ---", "成功任务: 1 个", "失败任务: 1 个", "跳过任务: 0 个", "上游失败任务: 0 个",
        "--- 任务类型统计 ---", "脚本执行任务: 1 个",
        "--- 执行时间统计 ---", "总执行时间: N/A", "开始时间(北京时间): 2024-01-01 08:00:00", "结束时间(北京时间): N/A",
        "--- 执行时间最长的任务 ---", "1. a-TO-b: 2分钟 5秒 (success)",
        "--- 失败任务详情 ---", "1. 任务ID: c", "   状态: failed", "   尝试次数: 2", "   执行时间: N/A",
        "--- 总结 ---", "任务成功率: 50.00%", "脚本执行过程中出现失败。有 1 个任务失败。", "========== 报告结束 ==========",
    ]


def test_numbers_within_a_large_key(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id * 7919 % 3001 AS v", "id")
    numbers = runlog.numbered(rows.repartition(7), ["k"], ["v", "id"]).collect()
    by_key = {}
    for r in sorted(numbers, key=lambda r: (r["k"], r["v"], r["id"])):
        by_key[r["k"]] = by_key.get(r["k"], 0) + 1
        assert r["number"] == by_key[r["k"]]
    assert len(numbers) == 3000 and runlog.numbered(rows.limit(0), ["k"], ["v"]).collect() == []


def test_fold_keeps_the_last_event(spark):
    events = spark.createDataFrame(
        [
            ("2024-01-01", "t", "s", "start", datetime(2024, 1, 1, 1), 1, None, None),
            ("2024-01-01", "t", "s", "end", datetime(2024, 1, 1, 2), 2, False, 3600.0),
            ("2024-01-01", "t", "s", "start", datetime(2024, 1, 1, 3), 3, None, None),
            ("2024-01-01", "u", "s", "end", datetime(2024, 1, 1, 4), 1, True, 1.0),
        ],
        "exec_date string, target_table string, script_name string, kind string, event_time timestamp_ntz, written int, success boolean, duration double",
    )
    got = {r["target_table"]: r[3:] for r in runlog.fold_task_log(events).collect()}
    assert got["t"] == (datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 2), 3600.0, False)
    assert got["u"] == (None, datetime(2024, 1, 1, 4), 1.0, True)


def task_events(seed, n=120):
    deal = random.Random(seed)
    pick = deal.choice
    return [
        (pick(["2024-01-01", "2024-01-02", None]), pick(["t", "u", None]), pick(["s", ""]), pick(["start", "end", "end", "other"]),
         pick([None, datetime(2024, 1, 1, pick(range(24)), 0, 0, pick([0, 1]))]), pick([1, 2, 3, None]), pick([True, False, None]), pick([None, 0.5, 60.0]))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("seed", "cuts"), [(1, [120]), (2, [1, 40, 41, 119]), (3, [60, 60])])
def test_stream_folds_as_the_batch_does(spark, seed, cuts):
    rows, events, folder = task_events(seed), new_dir(spark, "events"), new_dir(spark, "log")
    begun = 0
    for cut in [*cuts, len(rows)]:
        part = spark.createDataFrame(rows[begun:cut], tasklog.EVENTS)
        part.coalesce(1).write.mode("append").parquet(events)
        begun = cut
    log = tasklog.fold_stream(spark, events, folder, files_per_batch=1)
    want = runlog.fold_task_log(spark.createDataFrame(rows, tasklog.EVENTS))
    assert log.dtypes == want.dtypes
    assert sorted(map(str, log.collect())) == sorted(map(str, want.collect()))


def test_stream_goes_on_and_tells_changes_only(spark):
    events, folder = new_dir(spark, "events"), new_dir(spark, "log")
    end = ("2024-01-01", "t", "s", "end", datetime(2024, 1, 1, 2), 2, False, 60.0)
    start = ("2024-01-01", "t", "s", "start", datetime(2024, 1, 1, 1), 1, None, None)
    drop = lambda *rows: spark.createDataFrame(rows, tasklog.EVENTS).coalesce(1).write.mode("append").parquet(events)
    drop()
    assert tasklog.task_log(spark, folder).collect() == tasklog.fold_stream(spark, events, folder).collect() == []
    drop(end)
    assert tasklog.fold_stream(spark, events, folder).head()[3:] == (None, datetime(2024, 1, 1, 2), 60.0, False)
    drop(start)
    after = tasklog.fold_stream(spark, events, folder).collect()
    assert [r[3:] for r in after] == [(datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2), 60.0, False)]
    drop(end, start, start[:5] + (0, None, None))  # delivered again, and a try before the last one
    assert tasklog.fold_stream(spark, events, folder).collect() == after
    assert spark.read.parquet(f"{folder}/log").count() == 2


def test_stream_folds_in_the_engine(spark, tmp_path):
    """State is kept by Spark's own operator, which counts its rows; none of it runs in Python."""
    n, events, folder = 20_000, new_dir(spark, "events"), new_dir(spark, "log")
    task = spark.range(n).select(F.lit("2024-01-01").alias("exec_date"), F.lit("t").alias("target_table"), F.col("id").cast("string").alias("script_name"))
    for kind in ("end", "start"):
        task.select(
            "*", F.lit(kind).alias("kind"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("event_time"),
            F.lit(1).cast("bigint").alias("written"), F.lit(True).alias("success"), F.lit(1.0).cast("double").alias("duration"),
        ).write.mode("append").parquet(events)
        log = tasklog.fold_stream(spark, events, folder)
    assert log.filter("exec_start_time = exec_end_time AND exec_result").count() == n
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")  # the reader of one value per key
    assert state.count() == n and set(state.schema["key"].dataType.names) == set(tasklog.KEY)
    assert [f.dataType.names[-1] for f in state.schema["value"].dataType] == ["age", "age"]


@pytest.fixture
def ingested(spark):
    name = scratch_table(spark, "ingested")
    create_table(spark, name, spark.createDataFrame([], "id int, name string, created_at timestamp_ntz, ingest_batch bigint").schema, ["ingest_batch"])
    return name


def ids(spark, table):
    return sorted(r["id"] for r in spark.table(table).collect())


def test_each_file_once_then_archived(spark, tmp_path, ingested):
    drop, archive, checkpoint = tmp_path / "drop", tmp_path / "archive", new_dir(spark, "checkpoint")
    drop.mkdir()
    (drop / "a.csv").write_text("id,name\n1,x\n2,NULL\n")
    (drop / "b.csv").write_bytes("NAME,ID\n商,3\n".encode("gbk"))
    run = lambda: stream.ingest(spark, f"file:{drop}", ingested, checkpoint, archive=f"file:{archive}", relative="in", stamp=datetime(2024, 1, 1))
    assert run() == 1
    assert ids(spark, ingested) == [1, 2, 3] and not list(drop.iterdir())
    kept = [p for p in archive.rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert {p.parent.parent.name for p in kept} == {"in"} and sorted(p.name.split("_")[0] for p in kept) == ["a", "b"]
    (drop / "c.csv").write_text("id\n4\n")
    (drop / "d.csv").write_text("")
    assert run() == 1 and run() == 0
    assert ids(spark, ingested) == [1, 2, 3, 4]
    assert {r["created_at"] for r in spark.table(ingested).collect()} == {datetime(2024, 1, 1)}


def test_a_late_file_of_an_old_time_is_loaded(spark, tmp_path, ingested):
    drop, archive, checkpoint = tmp_path / "drop", tmp_path / "archive", new_dir(spark, "checkpoint")
    drop.mkdir()
    run = lambda: stream.ingest(spark, f"file:{drop}", ingested, checkpoint, archive=f"file:{archive}")
    (drop / "new.csv").write_text("id\n1\n")
    assert run() == 1
    (drop / "old.csv").write_text("id\n2\n")
    os.utime(drop / "old.csv", (time.time() - 30 * 86400,) * 2)
    assert run() == 1 and ids(spark, ingested) == [1, 2] and not list(drop.glob("*.csv"))


def test_a_failing_batch_is_replayed_once(spark, tmp_path, ingested):
    drop, checkpoint = tmp_path / "drop", new_dir(spark, "checkpoint")
    drop.mkdir()
    (drop / "a.csv").write_text("id\n1\n")
    (drop / "b.csv").write_text("id\nword\n")
    with pytest.raises(Exception):
        stream.ingest(spark, f"file:{drop}", ingested, checkpoint)
    (drop / "b.csv").write_text("id\n2\n")
    stream.ingest(spark, f"file:{drop}", ingested, checkpoint)
    stream.ingest(spark, f"file:{drop}", ingested, checkpoint)
    assert ids(spark, ingested) == [1, 2]


def test_a_file_that_vanishes_is_an_error_and_the_others_are_loaded(spark, tmp_path, ingested, monkeypatch):
    drop, archive, checkpoint = tmp_path / "drop", tmp_path / "archive", new_dir(spark, "checkpoint")
    drop.mkdir()
    for i in (1, 2, 3):
        (drop / f"{i}.csv").write_text(f"id\n{i}\n")
    there = stream.FileSystem.exists
    monkeypatch.setattr(stream.FileSystem, "exists", lambda self, path: not path.endswith("/2.csv") and there(self, path))
    run = lambda: stream.ingest(spark, f"file:{drop}", ingested, checkpoint, archive=f"file:{archive}")
    with pytest.raises(Exception, match="2.csv"):
        run()
    assert ids(spark, ingested) == [1, 3] and len(list(drop.glob("*.csv"))) == 3  # loaded, nothing archived yet
    monkeypatch.undo()
    archived = []
    monkeypatch.setattr(stream, "archive_files", lambda session, paths, *rest: archived.append([p[-5:] for p in paths]))
    assert run() == 2  # what was loaded is only archived; the file is back, and loaded
    assert archived == [["1.csv", "3.csv"], ["2.csv"]] and ids(spark, ingested) == [1, 2, 3]


def test_a_replay_after_the_write_does_not_lose_rows(spark, tmp_path, ingested, monkeypatch):
    drop, archive, checkpoint = tmp_path / "drop", tmp_path / "archive", new_dir(spark, "checkpoint")
    drop.mkdir()
    (drop / "a.csv").write_text("id\n1\n")
    (drop / "b.csv").write_text("id\n2\n")
    moved = stream.archive_files

    def stop(session, paths, *rest):
        moved(session, paths[:1], *rest)
        raise RuntimeError("stopped between two moves")

    run = lambda: stream.ingest(spark, f"file:{drop}", ingested, checkpoint, archive=f"file:{archive}")
    monkeypatch.setattr(stream, "archive_files", stop)
    with pytest.raises(Exception, match="between two moves"):
        run()
    monkeypatch.undo()
    assert run() == 1 and ids(spark, ingested) == [1, 2] and not list(drop.glob("*.csv"))


def test_a_name_that_recurs_is_loaded_each_time(spark, tmp_path, ingested):
    drop, archive, checkpoint = tmp_path / "drop", tmp_path / "archive", new_dir(spark, "checkpoint")
    drop.mkdir()
    run = lambda: stream.ingest(spark, f"file:{drop}", ingested, checkpoint, archive=f"file:{archive}")
    for turn in (1, 2, 3):
        (drop / "sales.csv").write_text(f"id\n{turn}\n")
        os.utime(drop / "sales.csv", (1_700_000_000,) * 2)  # the same time and length as before
        assert run() == 1 and not list(drop.glob("*.csv"))
    assert run() == 0 and ids(spark, ingested) == [1, 2, 3]
    assert len([p for p in archive.rglob("sales_*.csv")]) == 3
    assert stream.Ledger(spark, checkpoint).entries().count() == 0  # nothing is left in the drop


def test_the_ledger_holds_what_is_in_the_drop(spark, tmp_path, ingested):
    drop, checkpoint = tmp_path / "drop", new_dir(spark, "checkpoint")
    drop.mkdir()
    run = lambda n: stream.ingest(spark, f"file:{drop}", ingested, checkpoint, files_per_batch=n)
    for i in range(5):
        (drop / f"{i}.csv").write_text(f"id\n{i}\n")
    assert run(2) == 3 and run(2) == 0
    ledger = stream.Ledger(spark, checkpoint)
    assert (ledger.done, ledger.entries().count(), len(ledger.entries().inputFiles())) == (2, 5, 1)
    for i in (0, 1, 2):
        (drop / f"{i}.csv").unlink()
    (drop / "3.csv").write_text("id\n33\n")  # a new version under a known name
    assert run(2) == 1 and ids(spark, ingested) == [0, 1, 2, 3, 4, 33]
    ledger = stream.Ledger(spark, checkpoint)
    assert sorted(r["path"][-5:] for r in ledger.entries().collect()) == ["3.csv", "4.csv"] and ledger.done == 3


def test_a_stop_after_the_entry_neither_loads_again_nor_loses(spark, tmp_path, ingested, monkeypatch):
    drop, archive, checkpoint = tmp_path / "drop", tmp_path / "archive", new_dir(spark, "checkpoint")
    drop.mkdir()
    run = lambda: stream.ingest(spark, f"file:{drop}", ingested, checkpoint, archive=f"file:{archive}")
    (drop / "a.csv").write_text("id\n1\n")
    finish = stream.Ledger.finish
    monkeypatch.setattr(stream.Ledger, "finish", lambda self, batch: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        run()
    monkeypatch.setattr(stream.Ledger, "finish", finish)
    (drop / "a.csv").write_text("id\n22\n")  # the next file of that name is already there
    assert run() == 2 and ids(spark, ingested) == [1, 22] and not list(drop.glob("*.csv"))


def test_archive_path():
    assert stream.archive_path("/arc/", "in/x", date(2024, 1, 2), "file:/d/a.b.csv", 7) == "/arc/in/x/2024-01-02/a.b_7.csv"
    assert stream.archive_path("/arc", "", date(2024, 1, 2), "plain", 7) == "/arc/2024-01-02/plain_7"


def test_target_must_keep_batches_apart(spark):
    name = scratch_table(spark, "plain")
    create_table(spark, name, spark.createDataFrame([], "id int").schema)
    with pytest.raises(ValueError, match="ingest_batch"):
        stream.ingest(spark, "file:/none", name, "/none")
