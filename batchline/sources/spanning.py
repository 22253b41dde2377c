"""Records of CSV files whose quoted fields hold line breaks, without reading a file in one
task.

A line may begin inside a quoted field or outside of one. What it does to that state is one of
four things: leave it, turn it, or end inside or outside whatever came before. These can be
chained, so the state before each line follows from running sums in its split, and the state
before each split from one small row per split. Only the lines of records that span lines are
brought together, and only once it is known that every quote is closed.

Lines end at a line feed, a carriage return or both. A reader splits at one of the two; what it
returns is cut at the other one into pieces, each with the line end before it, and the state is
carried from piece to piece. So a file may be written in either way, or in both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchline.scratch import Scratch

_SPLIT = ["path", "block"]
# whole fields from the left: quoted (a quote opens only where a field begins, "" stands for one,
# what follows the closing quote belongs to the field) or not
_WHOLE_FIELDS = r'\G(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)(?:,|\z)'
_CLOSING = r'^(?:[^"]++|"")*+"[^,]*+(?:,|\z)'


def without_mark(line: Column) -> Column:
    """A line without the byte order mark that may begin a file."""
    return F.regexp_replace(line, "^\ufeff", "")


def opens(line: Column) -> Column:
    """Whether a line that begins outside of a quoted field ends inside of one."""
    return F.length(F.regexp_replace(line, _WHOLE_FIELDS, "")) > 0


def stays_open(line: Column) -> Column:
    """Whether a line that begins inside a quoted field ends inside of one."""
    return F.when(line.rlike(_CLOSING), opens(F.regexp_replace(line, _CLOSING, ""))).otherwise(True)


def line_end(start: bytes) -> str:
    """The line end that splits a file with this beginning more finely. Any choice gives the same
    records; it decides how much of the file is one line."""
    feeds = start.count(b"\n")
    return "\r" if start.count(b"\r") - start.count(b"\r\n") > feeds else "\n"


def _pieces(line: Column, end: str) -> Column:
    """``lead, value`` of the pieces of a line that was read up to ``end``: the line end before a
    piece, and its text. The return of a return and feed stays at the end of its piece, or leads."""
    if end == "\n":
        parts = F.split(line, r"\r(?!\z)")
        return F.transform(parts, lambda v, i: F.struct(F.when(i == 0, "\n").otherwise("\r").alias("lead"), v.alias("value")))
    both = line.startswith("\n")
    parts = F.split(F.when(both, F.substring(line, 2, 2**31 - 1)).otherwise(line), "\n")
    first = F.when(both, "\r\n").otherwise("\r")
    return F.transform(parts, lambda v, i: F.struct(F.when(i == 0, first).otherwise("\n").alias("lead"), v.alias("value")))


def _lines(spark: SparkSession, paths: Sequence[str], encoding: str, end: str) -> DataFrame:
    raw = F.col("value")
    text = raw if encoding == "UTF-8" else F.decode(raw.cast("binary"), encoding)
    whole = spark.read.option("lineSep", end).text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), without_mark(text).alias("line"),
    )
    lines = whole.select("path", "block", F.inline(_pieces(F.col("line"), end))).select(
        "path", "block", F.monotonically_increasing_id().alias("at"), "lead", "value"
    )
    ended = lines.select("*", opens(F.col("value")).cast("int").alias("from_out"), stays_open(F.col("value")).cast("int").alias("from_in"))
    return ended.withColumns({"turns": ((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int"), "sets": F.col("from_out") == F.col("from_in")})


def _state(start: Column, turned: Column, last: Column) -> Column:
    """The state after so many turns, counted from the last line that set it, if one did."""
    return F.when(last.isNull(), start + turned).otherwise(last["to"] + turned - last["turned"]) % 2


def _placed(spark: SparkSession, paths: Sequence[str], encoding: str, end: str) -> DataFrame:
    """Lines with the position of their record's first line, and whether they begin and end one."""
    lines = _lines(spark, paths, encoding, end)
    splits = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)

    turned = lines.withColumn("turned", F.sum("turns").over(to_here))
    set_here = F.when(F.col("sets"), F.struct(F.col("from_out").alias("to"), "turned"))
    within = turned.withColumns(
        {"last": F.last(set_here, ignorenulls=True).over(earlier), "so_far": F.coalesce(F.sum("turns").over(earlier), zero)}
    )
    # one row per split of a file: the windows over them stay small
    whole = turned.groupBy(*_SPLIT).agg(
        F.sum("turns").alias("turns"), F.max_by(set_here, F.when(F.col("sets"), F.col("at"))).alias("last")
    ).withColumn("to", F.when(F.col("last").isNotNull(), _state(zero, F.col("turns"), F.col("last"))))
    sums = whole.withColumn("turned", F.coalesce(F.sum(F.when(F.col("to").isNull(), F.col("turns"))).over(splits.rowsBetween(Window.unboundedPreceding, 0)), zero))
    split_sets = F.when(F.col("to").isNotNull(), F.struct("to", "turned"))
    begun = sums.withColumns({
        "before": F.coalesce(F.lag("turned").over(Window.partitionBy("path").orderBy("block")), zero),
        "set_before": F.last(split_sets, ignorenulls=True).over(splits),
    }).select(*_SPLIT, _state(zero, F.col("before"), F.col("set_before")).alias("start"))
    inside = _state(F.col("start"), F.col("so_far"), F.col("last"))
    marked = within.join(begun, _SPLIT).withColumn("inside", inside == 1).select(
        *_SPLIT, "at", "lead", "value", (~F.col("inside")).alias("begins"),
        (F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")) == 0).alias("ends"),
    )
    begin = F.when(F.col("begins"), F.struct("block", "at"))
    last_begin = marked.groupBy(*_SPLIT).agg(F.max(begin).alias("last")).select(
        *_SPLIT, F.last("last", ignorenulls=True).over(splits).alias("inherited")
    )
    own = marked.withColumn("own", F.last(begin, ignorenulls=True).over(to_here))
    return own.join(last_begin, _SPLIT).select(
        *_SPLIT, "at", "lead", "value", "begins", "ends", F.coalesce("own", "inherited").alias("first")
    )


def place(spark: SparkSession, paths: Sequence[str], encoding: str, end: str = "\n") -> DataFrame:
    """The lines of the files with their places, stored: header, checks and data share them.

    A quote that is never closed is an error, before any line is joined to another.
    """
    placed, _ = Scratch(spark, "spanning").save(_placed(spark, paths, encoding, end), "lines")
    last = placed.groupBy("path").agg(F.max_by("ends", F.struct("block", "at")).alias("closed"))
    unclosed = sorted(row["path"] for row in last.filter(~F.col("closed")).collect())  # one row a file
    if unclosed:
        raise ValueError(f"a quoted field is not closed at the end of {unclosed}")
    return placed


def records(placed: DataFrame) -> DataFrame:
    """``path, first, text``: one row per record that is not blank, the header included."""
    alone = F.col("begins") & F.col("ends")
    single = placed.filter(alone).select("path", "first", F.col("value").alias("text"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "at", "begins", "lead", "value")))
    text = F.transform(ordered, lambda line: F.concat(F.when(line["begins"], "").otherwise(line["lead"]), line["value"]))
    spanning = placed.filter(~alone).groupBy("path", "first").agg(F.array_join(text, "").alias("text"))
    whole = single.unionByName(spanning).withColumn("text", F.rtrim(F.col("text"), F.lit("\r")))
    return whole.filter(F.trim("text") != "")


def headers(placed: DataFrame) -> dict[str, str]:
    """The text of the first record of each file."""
    first = records(placed).groupBy("path").agg(F.min_by("text", "first").alias("text"))
    return {row["path"]: row["text"] for row in first.collect()}  # one row a file


def data_records(placed: DataFrame, paths: Sequence[str]) -> DataFrame:
    """The text of every record but the first of each file."""
    every = records(placed.filter(F.col("path").isin(list(paths))))
    header = every.groupBy("path").agg(F.min("first").alias("header"))
    return every.join(header, "path").filter(F.col("first") != F.col("header")).select("text")
