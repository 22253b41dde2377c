"""Dropped CSV files: any of three encodings, any header, one job for all files.

One scan of the raw lines finds, per file, its encoding, its header line and whether a
quoted field spans lines. Files that agree on all three are read together, in splits.
A quoted field that is still open at the end of its file is an error.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchline.functions.values import drop_empty_rows, nullify_tokens
from batchline.operators.headers import select_matched
from batchline.scratch import FileSystem
from batchline.sources.spanning import data_records, headers, line_end, opens, place, without_mark

# The encodings tried, in order, under their Java names.
UTF8, GBK, LATIN1 = "UTF-8", "GBK", "ISO-8859-1"
_PYTHON_NAME = {UTF8: "utf-8-sig", GBK: "gbk", LATIN1: "latin-1"}

_EXTRA = "_extra_field"

# how a file is read in splits: line by line, or record by record
LINES, RECORDS = "lines", "records"
# bytes at the beginning of a file that tell which line ends it mostly has
_START = 1 << 16

# a frame with numbered columns, and the file's own headers for them
Headed = tuple[DataFrame, tuple[str, ...]]


@dataclass(frozen=True)
class FileClass:
    """Files that one reader call can take."""

    encoding: str
    header: tuple[str, ...]
    layout: str
    paths: tuple[str, ...]
    placed: DataFrame | None = None


@F.pandas_udf(T.BooleanType())
def _is_gbk(lines: pd.Series) -> pd.Series:
    def valid(line: bytes) -> bool:
        try:
            bytes(line).decode("gbk")
        except UnicodeDecodeError:
            return False
        return True

    return lines.map(valid)


def _raw_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with their bytes as they are, and where they come from."""
    return spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def classify(spark: SparkSession, paths: Sequence[str]) -> list[FileClass]:
    """Group files by encoding, header and line structure; empty files are left out.

    The result has one small row per file, no more than the list of paths itself.
    """
    value = F.col("value")
    # narrow rows before the grouping: only the first split of a file can hold its header
    facts = _raw_lines(spark, paths).select(
        "path",
        F.monotonically_increasing_id().alias("at"),
        F.is_valid_utf8(value).alias("utf8"),
        opens(without_mark(value)).alias("opens"),
        F.when((F.col("block") == 0) & (F.trim(value) != ""), value.cast("binary")).alias("head"),
    )
    found = facts.groupBy("path").agg(
        F.every("utf8").alias("utf8"),
        F.some("opens").alias("spans"),
        F.min_by("head", F.when(F.col("head").isNotNull(), F.col("at"))).alias("head"),
    )
    rows = [row for row in found.collect() if row["head"] is not None]
    doubtful = [row["path"] for row in rows if not row["utf8"]]
    gbk: set[str] = set()
    if doubtful:
        other = _raw_lines(spark, doubtful).filter(~F.is_valid_utf8("value"))
        checked = other.groupBy("path").agg(F.every(_is_gbk(F.col("value").cast("binary"))).alias("gbk"))
        gbk = {row["path"] for row in checked.collect() if row["gbk"]}
    encodings = {r["path"]: UTF8 if r["utf8"] else GBK if r["path"] in gbk else LATIN1 for r in rows}
    spanning = [r["path"] for r in rows if r["spans"]]
    files, placed, first = FileSystem(spark), {}, {}
    ends = {path: line_end(files.start(path, _START)) for path in spanning}
    for encoding, end in sorted({(encodings[path], ends[path]) for path in spanning}):
        _allow(spark, encoding)
        same = [path for path in spanning if (encodings[path], ends[path]) == (encoding, end)]
        placed[encoding, end] = place(spark, same, encoding, end)
        first |= headers(placed[encoding, end])
    groups: dict[tuple, list[str]] = {}
    for row in sorted(rows, key=lambda r: r["path"]):
        path, encoding = row["path"], encodings[row["path"]]
        text = bytes(row["head"]).decode(_PYTHON_NAME[encoding], errors="replace")
        if row["spans"]:
            text = first[path]
        layout = RECORDS if row["spans"] else LINES
        groups.setdefault((encoding, _field_names(text), layout, ends.get(path)), []).append(path)
    return [FileClass(*key[:3], tuple(same), placed.get((key[0], key[3]))) for key, same in groups.items()]


def _field_names(line: str) -> tuple[str, ...]:
    """Names of the header fields; empty and repeated ones get a number."""
    names: list[str] = []
    for position, name in enumerate(next(csv.reader(io.StringIO(line, newline=""), strict=False))):
        name = name or f"Unnamed: {position}"
        candidate, copies = name, 0
        while candidate in names:
            copies += 1
            candidate = f"{name}.{copies}"
        names.append(candidate)
    return tuple(names)


def _allow(spark: SparkSession, encoding: str) -> None:
    """Spark decodes GBK only under this setting, and when the read runs, not when it is
    declared; it stays set for the session."""
    if encoding == GBK:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


# a null never stands for itself in a file: tokens are turned into nulls afterwards
_FIELDS = {"escape": '"', "nullValue": "\u0000", "emptyValue": ""}


def _reader(spark: SparkSession, encoding: str):
    _allow(spark, encoding)
    return spark.read.options(**_FIELDS, encoding=encoding, header=True)


def _read_class(spark: SparkSession, files: FileClass) -> DataFrame:
    """All rows of the files as text; a row with more fields than the header is an error."""
    names = [*(f"c{i}" for i in range(len(files.header))), _EXTRA]
    schema = ", ".join(f"{name} string" for name in names)
    if files.layout == RECORDS:
        texts = data_records(files.placed, files.paths)
        rows = texts.select(F.from_csv("text", schema, _FIELDS).alias("r")).select("r.*")
    else:
        rows = _reader(spark, files.encoding).schema(schema).csv(list(files.paths))
    whole = F.when(F.col(_EXTRA).isNull(), True).otherwise(
        F.raise_error(F.lit(f"a row has more than {len(files.header)} fields")).cast("boolean")
    )
    return rows.filter(whole).drop(_EXTRA)


def read_delimited(spark: SparkSession, paths: Sequence[str]) -> Iterator[Headed]:
    """One all-text frame per class of files, null tokens as nulls, with its headers."""
    for files in classify(spark, paths):
        yield nullify_tokens(_read_class(spark, files)), files.header


def load_delimited(
    spark: SparkSession, paths: Sequence[str], comments: Mapping[str, str]
) -> DataFrame | None:
    """Rows of all files under the table's column names; null if the files hold nothing.

    Columns that no file has are absent; rows empty in every mapped column are dropped.
    """
    return union_matched(read_delimited(spark, paths), comments)


def union_matched(frames: Iterable[Headed], comments: Mapping[str, str]) -> DataFrame | None:
    """The matched columns of all frames without rows that are empty in all of them."""
    loaded = []
    for frame, headers in frames:
        mapped = select_matched(frame, comments, headers)
        loaded.append(drop_empty_rows(mapped, mapped.columns))
    if not loaded:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loaded)
