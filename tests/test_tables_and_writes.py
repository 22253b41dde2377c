from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from batchline.queries import scratch_table
from batchline.sinks import publish, retention, tables, writes
from batchline.sources.database import MissingWindowColumn, Split, jdbc_options, window_scan

START, END = date(2024, 1, 10), date(2024, 2, 5)


def rows(spark, table):
    return sorted(map(tuple, spark.table(table).collect()), key=str)


def dated(spark, values):
    df = spark.createDataFrame([(i, None if d is None else date.fromisoformat(d)) for i, d in values], "id int, d date")
    return df


OLD = [(1, "2024-01-01"), (2, "2024-01-10"), (3, "2024-02-04"), (4, "2024-02-05"), (5, None), (6, "2023-12-31")]
NEW = [(12, "2024-01-31"), (13, "2024-02-05")]
KEPT = [(1, "2024-01-01"), (4, "2024-02-05"), (5, None), (6, "2023-12-31")]


def target(spark, partition=None, grain="day"):
    name = scratch_table(spark, "target")
    df = dated(spark, OLD)
    if partition is None:
        tables.create_table(spark, name, df.schema)
    else:
        df = df.withColumn(partition, F.col("d") if grain == "day" else F.trunc("d", grain))
        tables.create_table(spark, name, df.schema, [partition])
    writes.append(df, name)
    return name


@pytest.mark.parametrize("grain", [None, "day", "month", "year"])
def test_window_replace_keeps_the_rest(spark, grain):
    name = target(spark, grain and "p", grain or "day")
    options = {"partition": "p", "grain": grain} if grain else {}
    writes.write(dated(spark, NEW[:1]), name, "replace_window", column="d", window=(START, END), **options)
    once = rows(spark, name)
    writes.write(dated(spark, NEW[:1]), name, "replace_window", column="d", window=(START, END), **options)
    assert rows(spark, name) == once
    got = sorted((r[0], r[1] and r[1].isoformat()) for r in once)
    assert got == sorted([*KEPT, NEW[0]])


@pytest.mark.parametrize("grain", [None, "day", "month"])
def test_window_replace_by_nothing_empties_the_window(spark, grain):
    name = target(spark, grain and "p", grain or "day")
    options = {"partition": "p", "grain": grain} if grain else {}
    writes.replace_window(dated(spark, []), name, "d", START, END, **options)
    assert sorted(r["id"] for r in spark.table(name).collect()) == [1, 4, 5, 6]
    writes.append(dated(spark, NEW).withColumn("p", F.col("d")) if grain == "day" else dated(spark, NEW), name)
    assert spark.table(name).count() == 6


def test_rows_outside_the_window_are_appended(spark):
    name = target(spark, "p", "month")
    outside = [(20, "2024-03-01"), (21, None), (22, "2024-02-28")]
    writes.replace_window(dated(spark, [NEW[0], *outside]), name, "d", START, END, partition="p", grain="month")
    assert sorted(r["id"] for r in spark.table(name).collect()) == [1, 4, 5, 6, 12, 20, 21, 22]


def test_window_from_the_table_itself(spark):
    name = target(spark)
    same = spark.table(name).filter(writes.in_window(F.col("d"), START, END))
    writes.replace_window(same.withColumn("id", F.col("id") + 100), name, "d", START, END)
    assert sorted(r["id"] for r in spark.table(name).collect()) == [1, 4, 5, 6, 102, 103]


def test_batches(spark):
    name = scratch_table(spark, "batches")
    df = spark.createDataFrame([(1,), (2,)], "id int")
    tables.create_table(spark, name, df.withColumn("batch_date", F.lit(None).cast("date")).schema, ["batch_date"])
    for day in (START, END, START):
        writes.replace_batch(df, name, day)
    assert rows(spark, name) == sorted([(1, START), (2, START), (1, END), (2, END)], key=str)
    writes.replace_batch(df.limit(0), name, START)
    assert rows(spark, name) == [(1, END), (2, END)]


def test_refresh_by_nothing_and_from_itself(spark):
    name = target(spark)
    with pytest.raises(Exception, match="UNSUPPORTED_OVERWRITE"):
        writes.full_refresh(spark.table(name).filter("id > 3"), name)
    assert spark.table(name).count() == 6
    writes.full_refresh(spark.table(name).filter("id > 3"), name, staged=True)
    assert sorted(r["id"] for r in spark.table(name).collect()) == [4, 5, 6]
    writes.full_refresh(dated(spark, []), name)
    assert spark.table(name).count() == 0


def test_append_by_name(spark):
    name = target(spark)
    writes.append(spark.sql("SELECT '2024-05-05' AS D"), name)
    assert (None, date(2024, 5, 5)) in rows(spark, name)
    with pytest.raises(ValueError, match="no column"):
        writes.append(spark.sql("SELECT 1 AS nobody"), name)
    with pytest.raises(Exception):
        writes.append(spark.sql("SELECT 'x' AS id"), name)


def test_refusals(spark):
    df = dated(spark, NEW)
    with pytest.raises(ValueError, match="unknown mode"):
        writes.write(df, "t", "upsert")
    name = target(spark)
    with pytest.raises(ValueError, match="window's column"):
        writes.write(df, name, "replace_window", window=(START, END))
    writes.write(df, name, "replace_window", window=(START, END), allow_duplicates=True)
    assert spark.table(name).count() == 8
    with pytest.raises(ValueError, match="not partitioned"):
        writes.replace_batch(df, name, START)


def test_window_scan(spark):
    df = dated(spark, OLD)
    assert sorted(r["id"] for r in window_scan(df, "D", START, END).collect()) == [2, 3]
    with pytest.raises(MissingWindowColumn):
        window_scan(df, "x", START, END)
    assert window_scan(df, "x", START, END, "full_scan").count() == 6


def test_jdbc_options():
    source = {"db_type": "MySQL", "host": "h", "port": 3306, "database": "d", "schema": "s", "source_table": "t", "username": "u", "password": "p"}
    options = jdbc_options(source, split=Split("id", "0", "100", 4))
    assert options["url"] == "jdbc:mysql://h:3306/d" and options["dbtable"] == "s.t"
    assert (options["partitionColumn"], options["numPartitions"]) == ("id", "4")
    with pytest.raises(ValueError, match="unknown database type"):
        jdbc_options({**source, "db_type": "sqlite"})


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("varchar(20)", "STRING"), ("numeric(18, 2)", "DECIMAL(18,2)"), ("int8", "BIGINT"), ("Timestamp", "TIMESTAMP_NTZ"),
        ("timestamp(6) without time zone", "TIMESTAMP_NTZ"), ("timestamptz", "TIMESTAMP"), ("double precision", "DOUBLE"),
        ("int4[]", "ARRAY<INT>"), ("jsonb", "VARIANT"), ("numeric", "DECIMAL(38,18)"),
    ],
)
def test_types(spark, name, kind):
    assert tables.spark_type(name) == kind
    assert spark.range(1).select(tables.spark_type_column(F.lit(name))).head()[0] == kind


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError, match="money"):
        tables.spark_type("money")
    with pytest.raises(Exception, match="unknown column type: money"):
        spark.range(1).select(tables.spark_type_column(F.concat(F.lit("mon"), F.lit("ey")))).collect()


def test_create_from_metadata(spark, small):
    from batchline.fixtures import view

    nodes = spark.createDataFrame([("orders_x", "it's", "DataResource")], "en_name string, name string, label string")
    columns = spark.createDataFrame(
        [("orders_x", 2, "b", "text", "Bee", True), ("orders_x", 1, "A", "int4", None, True), ("orders_x", 3, "Create_Time", "date", "", False)],
        "table_name string, column_id int, en_name string, data_type string, name string, is_pk boolean",
    )
    spark.sql(f"CREATE DATABASE IF NOT EXISTS ods LOCATION '{_warehouse(spark)}'")
    assert tables.create_from_metadata(spark, nodes, columns, "orders_x")
    schema = spark.table("ods.orders_x").schema
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [
        ("A", "int"), ("b", "string"), ("Create_Time", "date"), ("update_time", "timestamp_ntz"),
    ]
    assert schema["b"].metadata["comment"] == "Bee"
    properties = {r["key"]: r["value"] for r in spark.sql("SHOW TBLPROPERTIES ods.orders_x").collect()}
    assert properties["pk"] == "A, b"
    assert not tables.create_from_metadata(spark, nodes, columns, "orders_x")
    with pytest.raises(LookupError):
        tables.create_from_metadata(spark, nodes, columns, "nobody")
    spark.sql("DROP TABLE ods.orders_x")


def _warehouse(spark):
    from batchline.scratch import new_dir

    return new_dir(spark, "ods")


def test_a_wide_table_has_all_its_columns(spark):
    nodes = spark.createDataFrame([("wide", "w", "DataModel")], "en_name string, name string, label string")
    columns = spark.range(2500).selectExpr(
        "'wide' AS table_name", "CAST(id AS int) AS column_id", "concat('c', id) AS en_name", "'int' AS data_type", "'' AS name", "false AS is_pk"
    )
    row = tables.table_ddl(nodes, columns).head()
    assert row["ddl"].count(" INT") == 2500 and row["ddl"].index("`c0`") < row["ddl"].index("`c2499`")


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "id int, r string")
    assert [tuple(r) for r in tables.duplicate_keys(df, ["id", "r"]).collect()] == [(1, "a", 2)]


def test_create_like_leaves_an_existing_table(spark):
    name = target(spark)
    assert not tables.create_like(spark, spark.range(1), name)
    other = scratch_table(spark, "like")
    assert tables.create_like(spark, spark.sql("SELECT 1 AS UPDATE_TIME"), other)
    assert spark.table(other).columns == ["UPDATE_TIME", "create_time"]


def files_of(spark, name):
    return set(spark.table(name).select("_metadata.file_path").distinct().toPandas()["file_path"])


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "switch", "delete"])
@pytest.mark.parametrize("kind", ["table", "partition"])
def test_a_write_that_is_killed_leaves_old_or_new_rows(spark, monkeypatch, kind, step):
    name = scratch_table(spark, "killed")
    df = spark.createDataFrame([(1,), (2,)], "id int")
    shape = df.withColumn("batch_date", F.lit(None).cast("date")) if kind == "partition" else df
    tables.create_table(spark, name, shape.schema, ["batch_date"] if kind == "partition" else [])

    def write(first):
        rows = df.withColumn("id", F.col("id") + first)
        if kind == "partition":
            writes.replace_batch(rows, name, START, staged=True)
        else:
            writes.full_refresh(rows, name, staged=True)

    def ids():
        return sorted(r["id"] for r in spark.table(name).collect())

    write(0)
    write(10)
    assert ids() == [11, 12]

    def stop(*args, **kwargs):
        raise Killed

    with monkeypatch.context() as patch:
        if step == "write":  # new files are there, the catalog does not know them
            real = type(spark).sql
            patch.setattr(type(spark), "sql", lambda self, text, *a, **k: stop() if "LOCATION '" in text else real(self, text, *a, **k))
        elif step == "switch":
            patch.setattr(type(spark.catalog), "refreshTable", stop)
        else:
            patch.setattr(publish.FileSystem, "delete", stop)
        with pytest.raises(Killed):
            write(20)
    spark.catalog.refreshTable(name)
    assert ids() == ([11, 12] if step == "write" else [21, 22])
    write(30)
    assert ids() == [31, 32]
    folder = files_of(spark, name).pop().rpartition("/")[0].rpartition("/")[0]
    assert len(publish.FileSystem(spark).children(folder)) == 1  # nothing of the killed run is left


def test_a_window_rewrites_only_the_batches_that_it_cuts(spark):
    name = scratch_table(spark, "batched")
    rows = [(i, START.replace(day=1 + i % 28), START.replace(month=1 + i // 28)) for i in range(28 * 4)]
    df = spark.createDataFrame([(i, d.replace(month=b.month), b) for i, d, b in rows], "id int, d date, batch_date date")
    tables.create_table(spark, name, df.schema, ["batch_date"])
    writes.append(df, name)
    before = {f for f in files_of(spark, name)}
    new = spark.createDataFrame([(1000, START.replace(month=2, day=3), START.replace(month=12))], "id int, d date, batch_date date")
    writes.replace_window(new, name, "d", START.replace(month=2, day=1), START.replace(month=2, day=20))
    after = files_of(spark, name)
    kept = {f for f in before if "batch_date=%d-02" % START.year not in f}
    assert kept < after and not (before - kept) & after
    want = sorted(r["id"] for r in df.collect() if not (r["d"].month == 2 and r["d"].day < 20)) + [1000]
    assert sorted(r["id"] for r in spark.table(name).collect()) == want
    writes.replace_window(new.limit(0), name, "d", START.replace(month=2, day=1), START.replace(month=4, day=1))
    assert sorted({r["d"].month for r in spark.table(name).collect()}) == [1, 4]
    assert {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()} == {f"batch_date={START.year}-0{m}-10" for m in (1, 4)}
    assert {f for f in before if "-01-10/" in f or "-04-10/" in f} == files_of(spark, name)


def test_old_plans_are_deleted_partition_by_partition(spark):
    name = scratch_table(spark, "plans")
    rows = [("d", START.replace(month=m), f"r{i}", datetime(2024, 1, 1, i), part) for m, n in ((1, 3), (2, 7), (3, 5)) for i in range(n) for part in (0, 1)]
    df = spark.createDataFrame(rows, "dag_id string, exec_date date, run_id string, create_time timestamp_ntz, part int")
    tables.create_table(spark, name, df.schema, ["exec_date"])
    writes.append(df.unionByName(df.filter("exec_date IS NULL")), name)
    before = files_of(spark, name)
    assert retention.delete_old_plans(spark, name, 5) == 4
    assert {f for f in before if "-02-" not in f} < files_of(spark, name)
    left = spark.table(name).filter("month(exec_date) = 2").select("run_id").distinct().collect()
    assert sorted(r["run_id"] for r in left) == ["r2", "r3", "r4", "r5", "r6"]
    assert retention.delete_old_plans(spark, name, 5) == 0 == retention.delete_old_plans(spark, name, 0)


def test_an_append_with_keys_that_are_not_new_is_refused(spark):
    name = scratch_table(spark, "keyed")
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "id int, kind string, v int")
    tables.create_table(spark, name, df.schema)
    writes.append_checked(df, name, ["id", "kind"])
    for bad, why in (([(2, "a", 9), (3, "a", 9)], "known"), ([(5, "x", 1), (5, "x", 2)], "repeated"), ([(None, "x", 1)], "null")):
        with pytest.raises(ValueError, match=why):
            writes.append_checked(spark.createDataFrame(bad, df.schema), name, ["id", "kind"])
        assert spark.table(name).count() == 3
    writes.append_checked(spark.createDataFrame([(2, "b", 4)], df.schema), name, ["id", "kind"])
    writes.append_checked(df.limit(0), name, ["id", "kind"])
    assert spark.table(name).count() == 4
