from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from batchline.functions import values
from batchline.operators.headers import NoMatchingColumn, column_comments, match_headers, select_matched


def test_comment_before_name():
    match = match_headers(["ID", "name", "Other"], {"name": "id", "id": "name"})
    assert match.mapping == {"ID": "name", "name": "id"}
    assert match.unmatched_headers == ("Other",)


def test_name_for_headers_without_comment_match():
    match = match_headers(["Id", "Full Name"], {"id": "Key", "name": "full name", "x": "x"})
    assert match.mapping == {"Full Name": "name", "Id": "id"}
    assert match.unmatched_columns == ("x",)


def test_last_of_equal_comments_and_spelling_of_equal_headers():
    assert match_headers(["Key"], {"a": "key", "b": "KEY"}).mapping == {"Key": "b"}
    assert match_headers(["key", "z", "KEY"], {"a": "key"}).mapping == {"KEY": "a"}


def test_spaces_inside_are_significant():
    assert match_headers(["full  name"], {"name": "full name"}).mapping == {}


def test_no_match_is_an_error(spark):
    with pytest.raises(NoMatchingColumn):
        select_matched(spark.createDataFrame([(1,)], "a int"), {"b": "b"})


def test_comments_of_a_table(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW plain AS SELECT 1 AS a")
    assert column_comments(spark, "plain") == {"a": "a"}


def test_null_tokens_are_exact(spark):
    rows = [("\\N",), ("",), ("NULL",), ("null",), ("Null",), ("NA",), ("nan",), (" ",)]
    got = [r[0] for r in values.nullify_tokens(spark.createDataFrame(rows, "v string")).collect()]
    assert got == [None] * 4 + ["Null", "NA", "nan", " "]


def test_empty_rows_are_counted(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, None), (None, "b")], "x string, y string")
    seen = Observation()
    values.drop_empty_rows(df, ["x", "y"], seen).write.parquet(str(tmp_path / "o"))
    assert seen.get["empty_rows"] == 1


def test_stamps(spark):
    df = spark.createDataFrame([(1,)], "id int")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    assert values.load_stamp(df, now, ["id", "created_at", "create_time"]).columns == ["id", "create_time"]
    assert values.load_stamp(df, now, ["id", "created_at"]).columns == ["id", "created_at"]
    assert values.load_stamp(df, now, ["id"]).columns == ["id"]
    assert values.copy_stamp(df.withColumn("UPDATE_TIME", F.lit(1)), now).columns == ["id", "UPDATE_TIME", "create_time"]


@pytest.mark.parametrize(
    ("name", "stem"), [("a.b.py", "a.b"), ("a", "a"), (".bashrc", ".bashrc"), ("a..b", "a."), ("x.", "x")]
)
def test_file_stem(spark, name, stem):
    assert spark.range(1).select(values.file_stem(F.lit(name))).head()[0] == stem


def test_task_id(spark):
    rows = [("run.py", ["b", "a"], "t"), ("LOAD_FILE.py", ["b"], "t"), ("run.py", [], "t"), ("run.py", None, "t")]
    df = spark.createDataFrame(rows, "n string, s array<string>, t string")
    got = [r[0] for r in df.select(values.task_id(F.col("n"), F.col("s"), F.col("t"))).collect()]
    assert got == ["run_a_b_to_t", "LOAD_FILE_t", "run_t", "run_t"]


def test_labels(spark):
    df = spark.createDataFrame([(["DataSource", "DataModel"],), (["X"],), (["DataResource"],), (None,)], "l array<string>")
    got = [tuple(r) for r in df.select(values.main_label(F.col("l")), values.layer_of(F.col("l"))).collect()]
    assert got == [("DataModel", "ads"), (None, "ads"), ("DataResource", "ods"), (None, "ads")]
