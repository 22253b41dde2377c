"""Periods, due dates and business time as expressions.

All of them work on dates and naive timestamps with named zones, so no result depends on
the session time zone.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The schedule frequencies and the business time zone.
FREQUENCIES = ("daily", "weekly", "monthly", "quarterly", "yearly")
BUSINESS_ZONE = "Asia/Shanghai"

_MONTHS = {"monthly": 1, "quarterly": 3, "yearly": 12}


def naive(when: datetime) -> Column:
    """A clock reading as a naive timestamp, whatever zone the session or the driver is in."""
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def _unknown(frequency: Column) -> Column:
    text = F.concat(F.lit("unknown frequency: "), F.coalesce(frequency, F.lit("null")))
    return F.raise_error(text).cast("date")


def period_start(day: Column, frequency: Column) -> Column:
    """First day of the period that holds ``day``; an unknown frequency is an error."""
    name = F.lower(frequency)
    return (
        F.when(name == "daily", day)
        .when(name == "weekly", F.trunc(day, "week"))
        .when(name == "monthly", F.trunc(day, "month"))
        .when(name == "quarterly", F.trunc(day, "quarter"))
        .when(name == "yearly", F.trunc(day, "year"))
        .otherwise(_unknown(frequency))
    )


def period_end(day: Column, frequency: Column) -> Column:
    """First day after the period: ranges are half-open."""
    name = F.lower(frequency)
    return (
        F.when(name == "daily", F.date_add(day, 1))
        .when(name == "weekly", F.date_add(F.trunc(day, "week"), 7))
        .when(name == "monthly", F.add_months(F.trunc(day, "month"), 1))
        .when(name == "quarterly", F.add_months(F.trunc(day, "quarter"), 3))
        .when(name == "yearly", F.add_months(F.trunc(day, "year"), 12))
        .otherwise(_unknown(frequency))
    )


def period_bounds(day: date | str, frequency: str) -> tuple[date, date]:
    """The same half-open period for one date, to bind as statement parameters."""
    day = date.fromisoformat(day) if isinstance(day, str) else day
    name = frequency.lower()
    if name == "daily":
        return day, day + timedelta(days=1)
    if name == "weekly":
        monday = day - timedelta(days=day.weekday())
        return monday, monday + timedelta(days=7)
    if name not in _MONTHS:
        raise ValueError(f"unknown frequency: {frequency}")
    span = _MONTHS[name]
    first = day.year * 12 + (day.month - 1) // span * span
    return _month_start(first), _month_start(first + span)


def _month_start(months: int) -> date:
    return date(months // 12, months % 12 + 1, 1)


def due_today(frequency: Column, day: Column) -> Column:
    """True on the last day of the period; no or unknown frequency is always due."""
    following = F.date_add(day, 1)
    name = F.lower(frequency)
    first_of_month = F.dayofmonth(following) == 1
    return (
        F.when(name == "weekly", F.weekday(following) == 0)
        .when(name == "monthly", first_of_month)
        .when(name == "quarterly", first_of_month & F.month(following).isin(1, 4, 7, 10))
        .when(name == "yearly", first_of_month & (F.month(following) == 1))
        .otherwise(F.lit(True))
    )


def day_start_utc(day: Column) -> Column:
    """The UTC instant, as a naive timestamp, at which the business day begins."""
    midnight = day.cast("timestamp_ntz")
    return F.convert_timezone(F.lit(BUSINESS_ZONE), F.lit("UTC"), midnight)


def day_end_utc(day: Column) -> Column:
    """24 hours after the business day begins."""
    return day_start_utc(day) + F.expr("INTERVAL 24 HOURS")


def business_time(instant: Column) -> Column:
    """A naive UTC timestamp as naive business time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(BUSINESS_ZONE), instant)


def business_date(instant: Column) -> Column:
    return F.to_date(business_time(instant))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two naive timestamps with fraction; null if either is null."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def hours_text(seconds: Column) -> Column:
    """Fixed format: hours, minutes and whole seconds; ``N/A`` when unknown."""
    whole = F.floor(seconds).cast("bigint")
    text = F.format_string(
        "%d小时 %d分钟 %d秒",
        F.floor(whole / 3600),
        F.floor(whole % 3600 / 60),
        whole % 60,
    )
    return F.when(seconds.isNotNull(), text).otherwise("N/A")


def minutes_text(seconds: Column) -> Column:
    """Fixed format: minutes and whole seconds; ``N/A`` when unknown."""
    whole = F.floor(seconds).cast("bigint")
    text = F.format_string("%d分钟 %d秒", F.floor(whole / 60), whole % 60)
    return F.when(seconds.isNotNull(), text).otherwise("N/A")


def local_time_text(instant: Column) -> Column:
    """Business time to the second, ``N/A`` when unknown."""
    text = F.date_format(business_time(instant), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(text, F.lit("N/A"))
