from __future__ import annotations

import uuid
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from batchline.operators import documents
from batchline.plans import transforms
from batchline.plans.loads import copy_source, load_location
from batchline.queries import scratch_table
from batchline.queries.loading import _workbook
from batchline.scratch import shared_dir
from batchline.sinks.tables import create_table
from batchline.sinks.writes import full_refresh

DAY = date(2024, 3, 5)


def ids(spark, table):
    return sorted(r["id"] for r in spark.table(table).collect())


def test_location_by_batch(spark, tmp_path):
    name = scratch_table(spark, "loaded")
    create_table(spark, name, spark.createDataFrame([], "id int, name string, create_time timestamp_ntz, batch_date date").schema, ["batch_date"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("ID,Name\n1,x\n")
    (tmp_path / "in" / "b.xlsx").write_bytes(_workbook([("name", "id"), ("y", 2)]))
    for _ in range(2):
        loaded = load_location(spark, f"file:{tmp_path}", "/in", name, "replace_batch", exec_date=DAY, stamp=datetime(2024, 3, 6))
        assert len(loaded) == 2 and ids(spark, name) == [1, 2]
    row = spark.table(name).filter("id = 2").head()
    assert (row["name"], row["create_time"], row["batch_date"]) == ("y", datetime(2024, 3, 6), DAY)


def test_no_file_leaves_the_table_and_an_empty_file_clears_it(spark, tmp_path):
    name = scratch_table(spark, "loaded")
    create_table(spark, name, spark.createDataFrame([], "id int").schema)
    (tmp_path / "a.csv").write_text("id\n1\n")
    load_location(spark, f"file:{tmp_path}", "a.csv", name, "full_refresh")
    assert load_location(spark, f"file:{tmp_path}", "none", name, "full_refresh") == []
    assert ids(spark, name) == [1]
    (tmp_path / "b.csv").write_text("")
    load_location(spark, f"file:{tmp_path}", "b.csv", name, "full_refresh")
    assert ids(spark, name) == []


def test_copy_of_a_window(spark):
    source = spark.createDataFrame([(1, date(2024, 3, 1)), (2, date(2024, 3, 5)), (3, date(2024, 4, 1))], "id int, d date")
    name = scratch_table(spark, "copied")
    for _ in range(2):
        copy_source(source, name, "replace_window", exec_date=DAY, frequency="monthly", column="D")
        assert ids(spark, name) == [1, 2]
    with pytest.raises(ValueError, match="gone"):
        copy_source(source, name, "replace_window", exec_date=DAY, column="gone")
    copy_source(source, name, "replace_window", exec_date=DAY, column="gone", on_missing="full_scan")
    assert ids(spark, name) == [1, 2, 3]


def _files(spark, table):
    rows = spark.table(table).select("d", F.col("_metadata.file_path").alias("f")).collect()
    return {(r["d"], r["f"]) for r in rows}


def _left_behind(spark):
    return [p for p in Path(shared_dir(spark), "batchline").rglob("*-rows") if "staged" in str(p)]


@pytest.mark.parametrize("way", ["copy", "store", "store_named"])
def test_a_window_rewrites_only_its_partitions(spark, way):
    days = [date(2024, m, d) for m in (1, 2, 3) for d in (1, 5, 20)]
    source = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, d date")
    name, before = scratch_table(spark, "windowed"), _left_behind(spark)

    def load(day, frequency):
        if way == "copy":
            copy_source(source, name, "replace_window", exec_date=day, frequency=frequency, column="d")
        else:
            start, end = transforms.period_bounds(day, frequency)
            named = {"partition": "p", "grain": "month"} if way == "store_named" else {}
            transforms.store(source.filter(F.col("d") >= F.lit(start)).filter(F.col("d") < F.lit(end)), name, str(day), frequency, "replace_window", column="d", **named)

    for month in (1, 2, 3):
        load(date(2024, month, 10), "monthly")
    assert ids(spark, name) == list(range(9))
    old = _files(spark, name)
    load(date(2024, 2, 1), "monthly")
    load(date(2024, 2, 5), "daily")  # a shorter window of the same table
    new = _files(spark, name)
    assert ids(spark, name) == list(range(9))
    assert {x for x in old if x[0].month != 2} == {x for x in new if x[0].month != 2}
    assert not {x for x in old if x[0].month == 2} & {x for x in new if x[0].month == 2}
    copy_source(source.filter("id < 0"), name, "replace_window", exec_date=date(2024, 3, 1), frequency="monthly", column="d")
    assert ids(spark, name) == list(range(6))
    if way != "store_named":
        copy_source(source.filter("id = 8"), name, "append")
        copy_source(source.filter("id < 0"), name, "replace_window", exec_date=date(2024, 3, 20), column="d")
        assert ids(spark, name) == list(range(6))
    assert _left_behind(spark) == before


def test_staged_rows_go_when_the_write_fails(spark):
    name, before = scratch_table(spark, "failing"), _left_behind(spark)
    create_table(spark, name, spark.createDataFrame([], "id int").schema)
    with pytest.raises(Exception):
        full_refresh(spark.sql("SELECT CAST(raise_error('no') AS int) AS id"), name, staged=True)
    assert _left_behind(spark) == before


@pytest.fixture
def described(spark):
    target = f"run_{uuid.uuid4().hex[:8]}"
    source = scratch_table(spark, "sold")
    spark.sql(f"CREATE TABLE {source} (sold date, amount int) USING parquet")
    spark.sql(f"INSERT INTO {source} VALUES (DATE'2024-02-05', 1), (DATE'2024-02-20', 2), (DATE'2024-03-05', 4)")
    nodes = spark.createDataFrame([(target, "Sums", "DataModel", "biz_date")], "en_name string, name string, label string, target_dt_column string")
    columns = spark.createDataFrame(
        [(target, 1, "biz_date", "date", "", True), (target, 2, "amount", "bigint", "", False)],
        "table_name string, column_id int, en_name string, data_type string, name string, is_pk boolean",
    )
    text = (
        f"-- daily sums\nINSERT INTO ads.{target} (biz_date, amount) SELECT sold, CAST(sum(amount) AS bigint) FROM {source} "
        "WHERE sold >= '{{ start_date }}' AND sold < DATE '{{ end_date }}' GROUP BY sold"
    )
    scripts = spark.createDataFrame([(target, "sums.sql", text, None)], "target_table string, script_name string, script_content string, target_dt_column string")

    def run(day, **options):
        written = transforms.run_script(spark, nodes, columns, scripts, target, "sums.sql", day, "monthly", **options)
        rows = spark.table(f"ads.{target}").select("biz_date", "amount", "batch_date").collect()
        return written, sorted(tuple(r) for r in rows)

    run.source, run.target, run.frames = source, target, (nodes, columns, scripts)
    yield run
    spark.sql(f"DROP TABLE IF EXISTS ads.{target}")


def test_a_stored_script_from_metadata_to_target(spark, described):
    feb, mar = date(2024, 2, 10), date(2024, 3, 10)
    both = [(date(2024, 2, 5), 1, feb), (date(2024, 2, 20), 2, feb)]
    for _ in range(2):  # scheduled: the batch of the date is replaced
        assert described(feb) == (2, both)
    assert described(mar, update_mode="append") == (1, both + [(date(2024, 3, 5), 4, mar)])
    spark.sql(f"INSERT INTO {described.source} VALUES (DATE'2024-02-07', 8)")
    later = date(2024, 2, 28)
    for _ in range(2):  # manual: the window is replaced, whatever batch wrote it
        written, rows = described(later, manual=True)
        assert written == 3 and [r[:2] for r in rows] == [(date(2024, 2, 5), 1), (date(2024, 2, 7), 8), (date(2024, 2, 20), 2), (date(2024, 3, 5), 4)]
        assert {r[2] for r in rows if r[0].month == 2} == {later}
    assert described(mar, update_mode="full_refresh") == (1, [(date(2024, 3, 5), 4, mar)])


def test_a_stored_script_that_cannot_run(spark, described):
    nodes, columns, scripts = described.frames
    with pytest.raises(LookupError, match="no script"):
        transforms.run_script(spark, nodes, columns, scripts, described.target, "gone.sql", DAY, "daily")
    with pytest.raises(LookupError, match="does not describe"):
        transforms.run_script(spark, nodes, columns, scripts, "nobody", "sums.sql", DAY, "daily")
    with pytest.raises(ValueError, match="unknown update mode"):
        described(DAY, update_mode="merge")
    unnamed = nodes.withColumn("target_dt_column", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="data_date"):
        transforms.run_script(spark, unnamed, columns, scripts, described.target, "sums.sql", DAY, "monthly", manual=True)


def test_store_counts_rows(spark):
    name = scratch_table(spark, "stored")
    df = spark.sql("SELECT 1 AS id UNION ALL SELECT 2")
    assert transforms.store(df, name, "2024-03-05", "daily", "replace_batch") == 2
    assert transforms.store(df.limit(0), name, "2024-03-05", "daily", "replace_batch") == 0
    assert spark.table(name).count() == 0


def test_plan_log(spark):
    plans = spark.createDataFrame([(DAY, 0, 1, "{}")], "exec_date date, part int, parts int, plan string")
    row = documents.plan_log(plans, "d", "r", datetime(2024, 3, 4, 20), datetime(2024, 3, 4, 21)).head()
    assert row["local_logical_date"] == datetime(2024, 3, 5, 4)


def _logged(spark, runs, parts):
    """A plan log: runs are (run id, hour saved); every plan has so many parts."""
    rows = [
        ("d", run, datetime(2024, 3, 4), DAY, part, parts, f"{run} {hour} {part}", datetime(2024, 3, 4, hour))
        for run, hour in runs for part in range(parts)
    ]
    return spark.createDataFrame(rows, "dag_id string, run_id string, logical_date timestamp_ntz, exec_date date, part int, parts int, plan string, create_time timestamp_ntz")


def test_retention_keeps_whole_plans(spark):
    log = _logged(spark, [(f"r{i}", i) for i in range(8)], 7)
    kept = documents.keep_latest(log, 5).collect()
    assert sorted({r["run_id"] for r in kept}) == ["r3", "r4", "r5", "r6", "r7"] and len(kept) == 35
    assert documents.keep_latest(log, 0).count() == 56


def test_as_of_finds_a_plan_without_create_time(spark):
    log = _logged(spark, [("r1", 1)], 3).withColumn("create_time", F.lit(None).cast("timestamp_ntz"))
    asked = spark.createDataFrame([("d", date(2024, 3, 9)), ("d", date(2024, 1, 1))], "dag_id string, ds date")
    found = documents.latest_as_of(asked, log).collect()
    assert sorted((str(r["ds"]), r["plan"] or "") for r in found) == [("2024-01-01", ""), *(("2024-03-09", f"r1 1 {i}") for i in range(3))]
    assert documents.latest_for(log, "d", "2024-03-09").count() == 3


def test_as_of_finds_all_parts_of_one_saved_plan(spark):
    log = _logged(spark, [("r1", 1), ("r2", 2), ("r2", 5)], 6)  # r2 saved its plan twice
    asked = spark.createDataFrame([("d", date(2024, 3, 9)), ("d", date(2024, 1, 1)), ("x", DAY)], "dag_id string, ds date")
    found = documents.latest_as_of(asked, log).collect()
    assert sorted(r["plan"] for r in found if r["plan"]) == [f"r2 5 {i}" for i in range(6)]
    assert sorted(str(r["ds"]) for r in found if not r["plan"]) == ["2024-01-01", "2024-03-05"]
    assert sorted(r["plan"] for r in documents.latest_for(log, "d", "2024-03-09").collect()) == [f"r2 5 {i}" for i in range(6)]
    assert documents.latest_for(log, "d", "2024-03-01").collect() == []
