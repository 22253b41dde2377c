from __future__ import annotations

from datetime import date

import pytest

from batchline.plans import transforms
from batchline.plans.templates import (
    TemplateError, UndefinedVariable, bind, run_statement, run_statements, split_insert, statements,
)
from batchline.queries import scratch_table

NAMES = {"start_date", "end_date", "t"}


@pytest.mark.parametrize(
    ("text", "bound"),
    [
        ("x >= '{{ start_date }}'", "x >= :start_date"),
        ('x >= "{{start_date}}"', "x >= :start_date"),
        ("x >= {{ start_date }};", "x >= :start_date"),
        ("x >= DATE '{{ start_date }}'", "x >= CAST(:start_date AS DATE)"),
        ("x = 'it''s {fine}' -- {{ nothing }}\nAND 1", "x = 'it''s {fine}'  \nAND 1"),
        ("{# note {{ x }} #} SELECT '{{- end_date -}}'", "SELECT :end_date"),
        ("x >= '{{ start_date }} 00:00:00'", "x >= concat(CAST(:start_date AS string), ' 00:00:00')"),
        ("'a{{ t }}b{{t}}'", "concat('a', CAST(:t AS string), 'b', CAST(:t AS string))"),
        ("SELECT /*+ BROADCAST(b) */ /* no hint */ 1", "SELECT /*+ BROADCAST(b) */   1"),
    ],
)
def test_bind(text, bound):
    assert bind(text, NAMES) == bound


@pytest.mark.parametrize(
    "text", ["{% if x %} 1", "'day {{ start_date }} {{ a.b }}'", "{{ start_date | upper }}", "{{ a.b }}", "''{{ missing }}''"]
)
def test_what_cannot_be_bound(text):
    with pytest.raises(TemplateError):
        bind(text, NAMES)


def test_undefined_name_is_an_error():
    with pytest.raises(UndefinedVariable):
        bind("SELECT '{{ nobody }}'", NAMES)


def test_values_are_not_spliced(spark):
    row = run_statement(spark, "SELECT '{{ t }}' AS v", {"t": "' OR 1=1 --"}).head()
    assert row["v"] == "' OR 1=1 --"


def test_identifier_marker_is_refused(spark):
    with pytest.raises(Exception):
        run_statement(spark, "SELECT * FROM {{ t }}", {"t": "range(3)"}).collect()


def test_split_insert():
    assert split_insert("INSERT INTO a.b (x, `y`) SELECT 1, 2") == ("a.b", ["x", "y"], "SELECT 1, 2")
    assert split_insert("insert into b WITH c AS (SELECT 1) SELECT * FROM c")[0] == "b"
    assert split_insert("SELECT 1") == (None, None, "SELECT 1")


@pytest.mark.parametrize(
    ("text", "split"),
    [
        ("-- daily load\nINSERT INTO t (a) SELECT 1", ("t", ["a"], "SELECT 1")),
        ("/* x */ insert /* y */ into table `ods`.`my t` select 1", ("ods.my t", None, "select 1")),
        ("INSERT INTO t (SELECT 1)", ("t", None, "(SELECT 1)")),
        ("WITH q AS (SELECT 1 AS a), r(x) AS (SELECT 2)\nINSERT INTO b SELECT * FROM q", ("b", None, "WITH q AS (SELECT 1 AS a), r(x) AS (SELECT 2)\n SELECT * FROM q")),
        ("SELECT 'INSERT INTO t SELECT 1'", (None, None, "SELECT 'INSERT INTO t SELECT 1'")),
    ],
)
def test_split_insert_reads_tokens(text, split):
    assert split_insert(text) == split


@pytest.mark.parametrize("text", ["FROM {src} INSERT INTO {tgt} SELECT a", "WITH q AS (SELECT a FROM {src}) FROM q INSERT INTO {tgt} SELECT a INSERT INTO {tgt} SELECT a + 1", "FROM {src} INSERT OVERWRITE TABLE {tgt} SELECT a"])
def test_inserts_after_from_are_refused_and_write_nothing(spark, text):
    src, tgt = scratch_table(spark, "src"), scratch_table(spark, "tgt")
    for name in (src, tgt):
        spark.sql(f"CREATE TABLE {name} (a int) USING parquet")
    spark.sql(f"INSERT INTO {src} VALUES (1)")
    with pytest.raises(TemplateError):
        transforms.sql_frame(spark, text.format(src=src, tgt=tgt), "2024-01-01", "daily")
    assert spark.table(tgt).count() == 0


def test_a_recursive_query_with_a_limit_is_a_query(spark):
    text = "WITH RECURSIVE t(n) MAX RECURSION LEVEL 50 AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n FROM t"
    assert sorted(r[0] for r in transforms.sql_frame(spark, text, "2024-01-01", "daily").collect()) == [1, 2, 3, 4, 5]


def test_rows_that_a_statement_affected(spark):
    name = scratch_table(spark, "counted")
    spark.sql(f"CREATE TABLE {name} (a int, b string) USING parquet")
    text = f"INSERT INTO {name} (b, a) SELECT 'x', id FROM range(7); INSERT INTO TABLE {name} VALUES (8, 'y'); SELECT * FROM {name} WHERE a < 3; DROP TABLE {name}"
    assert run_statements(spark, text) == [7, 1, 3, None]


@pytest.mark.parametrize("text", ["DELETE FROM t", "INSERT OVERWRITE t SELECT 1", "DROP TABLE t", "SELECT 1; SELECT 2", "", "-- nothing", "INSERT INTO t"])
def test_what_is_no_query_is_refused_before_it_runs(spark, text):
    with pytest.raises(TemplateError):
        transforms.sql_frame(spark, text, "2024-01-01", "daily")


def test_a_commented_insert_does_not_run(spark):
    name = scratch_table(spark, "kept")
    spark.sql(f"CREATE TABLE {name} (a int) USING parquet")
    df = transforms.sql_frame(spark, f"-- daily load\nINSERT INTO {name} (a) SELECT 1", "2024-01-01", "daily")
    assert [tuple(r) for r in df.collect()] == [(1,)] and spark.table(name).count() == 0


def test_statements_in_order(spark):
    name = scratch_table(spark, "several")
    spark.sql(f"CREATE TABLE {name} (a string) USING parquet")
    text = f"INSERT INTO {name} VALUES ('x;{{{{ t }}}}'); -- next; one\nINSERT INTO {name} SELECT 'y' ;; SELECT * FROM {name};"
    assert len(statements(text)) == 3
    assert run_statements(spark, text, {"t": 7})[-1] == 2
    assert sorted(r[0] for r in spark.table(name).collect()) == ["x;7", "y"]


def test_sql_frame_names_and_period(spark):
    df = transforms.sql_frame(spark, "INSERT INTO t (a, b) SELECT '{{ start_date }}', '{{ end_date }}'", "2024-02-10", "monthly")
    assert df.head().asDict() == {"a": date(2024, 2, 1), "b": date(2024, 3, 1)}


def test_unregistered_python_transform(spark):
    with pytest.raises(LookupError):
        transforms.python_frame(spark, "nobody.py", "2024-01-01", "daily")
