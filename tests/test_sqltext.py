from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from batchline.functions import sqltext

CASES = [
    ("SELECT a.d AS day FROM a WHERE DATE(a.d) >= '{{ start_date }}' AND a.d < '{{end_date}}'", ["a.d"], "day"),
    ("SELECT d FROM a WHERE CAST(d AS date) >= \"{{ start_date }}\"", ["d"], "d"),
    ("SELECT x.y\n AS z FROM x WHERE x.y BETWEEN '{{ start_date }}' AND '{{ end_date }}'", ["x.y"], "z"),
    ("SELECT x.y FROM x WHERE x.y = {{ start_date }}", ["x.y"], None),
    ("SELECT 1 FROM t WHERE d <> '{{ other }}'", [], None),
    ("select b.q as r, c as s from t where b.q <= '{{ end_date }}' and c > '{{ start_date }}'", ["b.q", "c"], "r"),
]


@pytest.mark.parametrize(("text", "fields", "target"), CASES)
def test_fields_and_target(spark, text, fields, target):
    df = spark.createDataFrame([(text,)], "t string").select(
        sqltext.bound_fields(F.col("t")).alias("f"), sqltext.select_aliases(F.col("t")).alias("a")
    )
    row = df.select("f", sqltext.target_date_field(F.col("f"), F.col("a")).alias("d")).head()
    assert (row["f"], row["d"]) == (fields, target)


def test_last_alias_of_a_field_wins(spark):
    df = spark.createDataFrame([("SELECT a.b AS x, f(a) AS y, a.b AS z FROM t",)], "t string")
    assert df.select(sqltext.select_aliases(F.col("t"))).head()[0] == {"a.b": "z"}


def test_insert_target_and_delete(spark):
    df = spark.createDataFrame([("insert  into `ads.t` select 1",), ("SELECT 1",)], "t string")
    rows = df.select(sqltext.insert_target(F.col("t")), sqltext.window_delete(F.col("t"))).collect()
    assert rows[0][0] == "ads.t" and rows[0][1].startswith("DELETE FROM ads.t\nWHERE summary_date >= '{{ start_date }}'")
    assert tuple(rows[1]) == (None, None)
    given = df.select(sqltext.window_delete(F.col("t"), F.lit("x"))).collect()
    assert all("FROM x" in r[0] for r in given)
