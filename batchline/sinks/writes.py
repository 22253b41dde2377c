"""Writing to catalog tables: append, full refresh, and replacing a window or a batch.

Plain parquet tables know no row-level delete, so a replacement rewrites partitions. A
table partitioned by (a truncation of) the window's date rewrites only the partitions the
window touches; one that is partitioned by anything else, a batch date for instance, only those that
hold rows of the window or get new ones, found by the files' own statistics of the window's date. A
table without partitions is rewritten as a whole.

Whole tables and batches can be published at once (``staged``): see ``sinks.publish``. A replacement
of several partitions stages its rows in the shared folder and overwrites them; a reader may see the
target between two of them, and a run that dies there must be run again, which gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.scratch import Scratch, settings
from batchline.sinks.publish import publish_partition, publish_table, publishable
from batchline.sinks.tables import WINDOW_PART, duplicate_keys, quoted, window_layout

MODES = ("append", "full_refresh", "replace_window", "replace_batch")
GRAINS = ("day", "month", "quarter", "year")


def grain_of(frequency: str) -> str:
    """Partitions of a target that is loaded with this frequency."""
    return {"monthly": "month", "quarterly": "quarter", "yearly": "year"}.get(frequency.lower(), "day")


def mode_of(update_mode: str | None, manual: bool) -> str:
    """The write mode of a metadata mode. ``append`` (the default) never duplicates what a run
    wrote before: a manual run replaces the window, a scheduled one the batch of its date."""
    name = (update_mode or "append").strip().lower()
    if name == "full_refresh":
        return name
    if name != "append":
        raise ValueError(f"unknown update mode: {update_mode}")
    return "replace_window" if manual else "replace_batch"


def aligned(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df`` with the table's columns, order and types; columns it lacks are null.

    A column the table lacks is an error, and so is a value its type cannot hold.
    """
    names = {c.lower(): c for c in df.columns}
    unknown = set(names) - {c.lower() for c in table.columns}
    if unknown:
        raise ValueError(f"the target has no column {sorted(unknown)}")
    return df.select(
        *[
            (F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None))
            .cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _insert(df: DataFrame, table: str, overwrite: bool, partitions: list[str], dynamic: bool = False) -> None:
    if partitions:
        # rows of a partition go to few files, and a large partition is split over tasks
        df = df.hint("rebalance", *partitions)
    mode = "dynamic" if dynamic else "static"
    with settings(df.sparkSession, spark__sql__sources__partitionOverwriteMode=mode):
        df.write.insertInto(quoted(table), overwrite=overwrite)


def append(df: DataFrame, table: str) -> None:
    """Append by column name."""
    spark = df.sparkSession
    _insert(aligned(_dated(df, table), spark.table(table)), table, False, partition_columns(spark, table))


def _dated(df: DataFrame, table: str) -> DataFrame:
    """Rows for a target that is partitioned by windows, with their partition."""
    layout = window_layout(df.sparkSession, table)
    if layout is None or WINDOW_PART in df.columns or layout[0].lower() not in [c.lower() for c in df.columns]:
        return df
    return df.withColumn(WINDOW_PART, _truncated(F.col(layout[0]), layout[1]))


def full_refresh(df: DataFrame, table: str, staged: bool = False) -> None:
    """Replace the whole content; an empty source leaves an empty table.

    ``staged`` writes the rows elsewhere first: needed when ``df`` reads the target (Spark refuses it
    otherwise), and it leaves the target as it was when the source fails. A table without partitions
    is then published at once; one with partitions is written a second time.
    """
    spark = df.sparkSession
    rows, parts = aligned(_dated(df, table), spark.table(table)), partition_columns(spark, table)
    if staged and not parts and publishable(spark, table):
        publish_table(rows, table)
        return
    with _staged(rows, staged) as held:
        _insert(held, table, True, parts)


@contextmanager
def _staged(rows: DataFrame, staged: bool = True) -> Iterator[DataFrame]:
    """The rows from a copy in the shared folder, which is deleted at the end whatever happens."""
    if not staged:
        yield rows
        return
    scratch = Scratch(rows.sparkSession, "staged")
    try:
        yield scratch.save(rows, "rows")[0]
    finally:
        scratch.close()


def replace_batch(
    df: DataFrame, table: str, batch_date: date, column: str = "batch_date", staged: bool = False
) -> None:
    """Replace the one partition of a batch; an empty batch clears it.

    The partition is named by the execution date, not by the clock, so a later re-run
    replaces what the first run loaded. ``staged``: the batch is published at once, and its rows
    may be read from the target.
    """
    spark = df.sparkSession
    if partition_columns(spark, table) != [column]:
        raise ValueError(f"{table} is not partitioned by {column}")
    rows = aligned(df.drop(column), spark.table(table).drop(column))
    if staged and publishable(spark, table):
        day = batch_date.isoformat()
        publish_partition(rows, table, f"{quoted(column)} = DATE'{day}'", f"{column}={day}")
        return
    with _staged(rows, staged) as held:
        _overwrite_partition(held, table, column, batch_date)


def _overwrite_partition(rows: DataFrame, table: str, column: str, value: date) -> None:
    rows.sparkSession.sql(
        f"INSERT OVERWRITE TABLE {quoted(table)} PARTITION ({quoted(column)} = DATE'{value.isoformat()}') "
        "SELECT * FROM {rows}",
        rows=rows,
    )


def in_window(column: Column, start: date, end: date) -> Column:
    """``start <= column < end``; a null is outside."""
    return F.coalesce((column >= F.lit(start)) & (column < F.lit(end)), F.lit(False))


def replaced(target: DataFrame, new: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """The content after a window replacement: rows outside the window, and the new rows."""
    survivors = target.filter(~in_window(F.col(column), start, end))
    return survivors.unionByName(aligned(new, target))


def replace_window(
    df: DataFrame, table: str, column: str, start: date, end: date,
    partition: str | None = None, grain: str = "day",
) -> None:
    """Delete the target's rows in ``[start, end)`` of ``column`` and append ``df``.

    ``partition`` names the table's partition column if that is the window date truncated
    to ``grain``; then only partitions that overlap the window are read and rewritten. Of a table
    with other partitions those are rewritten that hold rows of the window or get new ones. Rows
    with a null date stay. New rows outside the window are appended.
    """
    spark = df.sparkSession
    target = spark.table(table)
    layout = window_layout(spark, table)
    if partition is None and layout is not None and layout[0].lower() == column.lower():
        partition, grain = WINDOW_PART, layout[1]
    if partition is None:
        parts = partition_columns(spark, table)
        if not parts:
            full_refresh(replaced(target, df, column, start, end), table, staged=True)
            return
        inside = in_window(F.col(column), start, end)
        with _staged(aligned(df, target)) as new:
            touched = partition_values(target.filter(inside).select(*parts).union(new.select(*parts)), parts)
            kept = target.filter(among(parts, touched)).filter(~inside)
            rewrite_partitions(kept.unionByName(new), table, touched)
        return
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    if partition_columns(spark, table) != [partition]:
        raise ValueError(f"{table} is not partitioned by {partition}")
    new = df if partition in df.columns else df.withColumn(partition, _truncated(F.col(column), grain))
    first, last = _floor(start, grain), _floor(end, grain)
    touched = (F.col(partition) >= F.lit(first)) & (F.col(partition) < F.lit(end))
    staged = aligned(new, target)
    # only a partition that the window cuts through can keep rows
    cut = [p for p, edge in ((first, start), (last, end)) if p != edge]
    if cut:
        in_cut = F.col(partition).isin(cut) & touched
        staged = target.filter(in_cut).filter(~in_window(F.col(column), start, end)).unionByName(staged)
    with _staged(staged) as staged:
        rewritten = staged.filter(touched)
        _insert(rewritten, table, True, [partition], dynamic=True)
        _clear(spark, table, partition, target, touched, rewritten)
        outside = staged.filter(~F.coalesce(touched, F.lit(False)))
        if not outside.isEmpty():
            _insert(outside, table, False, [partition])


def partition_values(rows: DataFrame, parts: list[str]) -> list[tuple]:
    """The partitions that rows lie in, a tuple of their columns' values for each: no more than the
    catalog lists."""
    return [tuple(row) for row in rows.select(*parts).distinct().collect()]


def among(parts: list[str], values: list[tuple]) -> Column:
    """Rows of these partitions, as a condition on partition columns only: others are not read."""
    if len(parts) == 1 and all(v[0] is not None for v in values):
        return F.col(parts[0]).isin([v[0] for v in values])
    out = F.lit(False)
    for value in values:
        same = F.lit(True)
        for part, v in zip(parts, value, strict=True):
            same = same & (F.col(part).isNull() if v is None else F.col(part) == F.lit(v))
        out = out | same
    return out


def rewrite_partitions(rows: DataFrame, table: str, touched: list[tuple]) -> None:
    """Replace the content of the ``touched`` partitions by ``rows``, which may be read from them;
    one that gets no rows is dropped. Files of other partitions stay as they are."""
    spark = rows.sparkSession
    parts = partition_columns(spark, table)
    if not touched:
        return
    with _staged(rows) as held:
        filled = set(partition_values(held, parts))
        if filled:
            _insert(held, table, True, parts, dynamic=True)
        empty = [v for v in touched if v not in filled]
        nothing = spark.createDataFrame([], spark.table(table).drop(*parts).schema)
        specs = []
        for values in empty:
            text = [f"{quoted(p)} = " + ("NULL" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'") for p, v in zip(parts, values, strict=True)]
            specs.append(f"PARTITION ({', '.join(text)})")
            spark.sql(f"INSERT OVERWRITE TABLE {quoted(table)} {specs[-1]} SELECT * FROM {{rows}}", rows=nothing)
        if specs:
            spark.sql(f"ALTER TABLE {quoted(table)} DROP IF EXISTS {', '.join(specs)}")


def append_checked(df: DataFrame, table: str, key: Sequence[str]) -> None:
    """Append rows whose key is new: a null key, one that occurs twice in ``df`` or one that the
    target holds is an error, and nothing is written.

    The rows are stored once. Of the target only the key columns are read, and of these only the row
    groups whose statistics meet the range of the new keys; then an exact join decides.
    """
    spark = df.sparkSession
    target, key = spark.table(table), list(key)
    with _staged(aligned(_dated(df, table), target)) as new:
        keys = new.select(*key)
        ends = keys.agg(*[end(c) for c in key for end in (F.min, F.max)]).head()
        near = reduce(and_, [F.col(c).between(ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(key)])
        problems = {
            "null": keys.filter(reduce(or_, [F.col(c).isNull() for c in key])).limit(5).collect(),
            "repeated": duplicate_keys(keys, key).select(*key).limit(5).collect(),
            "known": target.select(*key).filter(near).join(keys, key, "left_semi").limit(5).collect(),
        }
        found = {kind: [tuple(row) for row in rows] for kind, rows in problems.items() if rows}
        if found:
            raise ValueError(f"keys {key} of {table}: {found}")
        _insert(new, table, False, partition_columns(spark, table))


def _clear(
    spark: SparkSession, table: str, partition: str, target: DataFrame, touched: Column, rewritten: DataFrame
) -> None:
    """Empty the touched partitions that got no rows: at most one per day of the window. Their
    files go first, each by an overwrite; then one statement takes all their names away."""
    names = spark.sql(f"SHOW PARTITIONS {quoted(table)}")
    listed = names.select(
        F.to_date(F.nullif(F.substring_index("partition", "=", -1), F.lit("__HIVE_DEFAULT_PARTITION__"))).alias(partition)
    )
    filled = rewritten.select(partition).distinct()
    empty = [row[partition] for row in listed.filter(touched).join(filled, partition, "left_anti").collect()]
    nothing = spark.createDataFrame([], target.drop(partition).schema)
    for day in empty:
        _overwrite_partition(nothing, table, partition, day)
    if empty:
        specs = ", ".join(f"PARTITION ({quoted(partition)} = DATE'{day.isoformat()}')" for day in sorted(empty))
        spark.sql(f"ALTER TABLE {quoted(table)} DROP IF EXISTS {specs}")


def _truncated(column: Column, grain: str) -> Column:
    day = F.to_date(column)
    return day if grain == "day" else F.trunc(day, grain)


def _floor(day: date, grain: str) -> date:
    if grain == "day":
        return day
    month = {"month": day.month, "quarter": (day.month - 1) // 3 * 3 + 1, "year": 1}[grain]
    return date(day.year, month, 1)


def write(
    df: DataFrame, table: str, mode: str, *, column: str | None = None,
    window: tuple[date, date] | None = None, batch_date: date | None = None,
    partition: str | None = None, grain: str = "day", allow_duplicates: bool = False,
    staged: bool = False,
) -> None:
    """One entry for all modes; an unknown mode is an error.

    ``replace_window`` without a window column is refused unless ``allow_duplicates``, which
    makes it a plain append.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "append":
        append(df, table)
    elif mode == "full_refresh":
        full_refresh(df, table, staged)
    elif mode == "replace_batch":
        replace_batch(df, table, batch_date, staged=staged)
    elif column is not None:
        replace_window(df, table, column, *window, partition=partition, grain=grain)
    elif allow_duplicates:
        append(df, table)
    else:
        raise ValueError("replace_window needs the window's column")
