"""Loading a storage location or a source table into a target."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from batchline.functions.periods import naive, period_bounds
from batchline.functions.values import copy_stamp, load_stamp
from batchline.operators.headers import column_comments
from batchline.sinks.tables import create_like, create_window_target
from batchline.sinks.writes import grain_of, write
from batchline.sources.database import window_scan
from batchline.sources.discovery import find_files
from batchline.sources.files import load_files

BATCH_COLUMN = "batch_date"


def load_location(
    spark: SparkSession, base: str, location: str, table: str, mode: str, *,
    exec_date: date | None = None, stamp: datetime | None = None, **options,
) -> list[str]:
    """Load every file of a location and return their paths.

    No file at all leaves the table as it is, whatever the mode; files without a row replace
    it by nothing in the modes that replace. ``replace_batch`` fills the partition
    ``batch_date`` of the execution date; ``replace_window`` takes the options of ``write``.
    """
    paths = find_files(spark, base, location)
    if not paths:
        return []
    comments = {c: n for c, n in column_comments(spark, table).items() if c != BATCH_COLUMN}
    rows = load_files(spark, paths, comments)
    if rows is None:
        rows = spark.createDataFrame([], spark.table(table).drop(BATCH_COLUMN).schema)
    write(load_stamp(rows, naive(stamp or datetime.now()), list(comments)), table, mode, batch_date=exec_date, **options)
    return paths


def copy_source(
    source: DataFrame, table: str, mode: str, *, exec_date: date | str | None = None,
    frequency: str = "daily", column: str | None = None, on_missing: str = "error",
    stamp: datetime | None = None,
) -> None:
    """Copy a source into a target that is created like it.

    ``full_refresh`` copies everything. ``replace_window`` copies the period of the date and
    replaces it in the target; a source without the window column is an error, or with
    ``on_missing="full_scan"`` a full refresh. ``append`` adds the period, or everything if
    no column is given.
    """
    spark = source.sparkSession
    known = column is not None and column.lower() in [c.lower() for c in source.columns]
    if mode == "replace_window" and known:
        create_window_target(spark, source, table, column, grain_of(frequency))
    else:
        create_like(spark, source, table)
    now = naive(stamp or datetime.now())
    if mode == "full_refresh" or column is None:
        write(copy_stamp(source, now), table, mode)
        return
    window = period_bounds(exec_date, frequency)
    rows = copy_stamp(window_scan(source, column, *window, on_missing=on_missing), now)
    if known:
        write(rows, table, mode, column=column, window=window)
    else:
        write(rows, table, "full_refresh")
