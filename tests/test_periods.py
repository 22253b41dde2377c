from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchline.functions import periods

EDGES = [
    date(2024, 12, 31), date(2024, 2, 29), date(2023, 2, 28), date(2024, 3, 31), date(2024, 4, 1),
    date(2024, 6, 30), date(2024, 9, 30), date(2025, 1, 1), date(2024, 7, 7), date(2024, 7, 8),
]


@given(st.dates(date(1990, 1, 1), date(2100, 1, 1)), st.sampled_from(periods.FREQUENCIES))
def test_ranges_hold_the_day_and_tile(day, frequency):
    start, end = periods.period_bounds(day, frequency)
    assert start <= day < end
    assert periods.period_bounds(end, frequency)[0] == end
    assert periods.period_bounds(start - timedelta(days=1), frequency)[1] == start


def test_expression_equals_bounds(spark):
    rows = [(d, f) for d in EDGES for f in periods.FREQUENCIES]
    df = spark.createDataFrame(rows, "d date, f string")
    day, frequency = F.col("d"), F.upper("f")
    found = df.select("d", "f", periods.period_start(day, frequency).alias("s"), periods.period_end(day, frequency).alias("e"))
    for row in found.collect():
        assert (row["s"], row["e"]) == periods.period_bounds(row["d"], row["f"])


def test_unknown_frequency_is_an_error(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), "hourly")], "d date, f string")
    with pytest.raises(Exception, match="unknown frequency: hourly"):
        df.select(periods.period_start(F.col("d"), F.col("f"))).collect()
    with pytest.raises(ValueError, match="hourly"):
        periods.period_bounds("2024-01-01", "hourly")


@pytest.mark.parametrize(
    ("day", "frequency", "due"),
    [
        (date(2024, 7, 7), "weekly", True), (date(2024, 7, 8), "weekly", False), (date(2024, 2, 29), "monthly", True),
        (date(2024, 2, 28), "monthly", False), (date(2024, 6, 30), "quarterly", True), (date(2024, 5, 31), "quarterly", False),
        (date(2024, 12, 31), "YEARLY", True), (date(2024, 11, 30), "yearly", False), (date(2024, 7, 8), "daily", True),
        (date(2024, 7, 8), None, True), (date(2024, 7, 8), "", True), (date(2024, 7, 8), "hourly", True),
    ],
)
def test_due(spark, day, frequency, due):
    df = spark.createDataFrame([(day, frequency)], "d date, f string")
    assert df.select(periods.due_today(F.col("f"), F.col("d"))).head()[0] is due


def test_business_time_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 16), date(2024, 3, 10))], "t timestamp_ntz, d date")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = df.select(
                periods.business_date(F.col("t")), periods.day_start_utc(F.col("d")), periods.day_end_utc(F.col("d")),
                periods.elapsed_seconds(F.lit("2024-03-10 01:00:00").cast("timestamp_ntz"), F.lit("2024-03-10 04:00:00.5").cast("timestamp_ntz")),
            ).head()
            assert tuple(row) == (date(2024, 1, 2), datetime(2024, 3, 9, 16), datetime(2024, 3, 10, 16), 10800.5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_duration_texts(spark):
    df = spark.createDataFrame([(3725.9,), (None,)], "s double")
    rows = df.select(periods.hours_text(F.col("s")), periods.minutes_text(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("1小时 2分钟 5秒", "62分钟 5秒"), ("N/A", "N/A")]
