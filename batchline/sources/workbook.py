"""Dropped Excel workbooks (xlsx): the first sheet, every cell as text.

A workbook cannot be split and holds at most 1,048,576 rows, so a file is one unit of work;
files are spread over tasks.
"""

from __future__ import annotations

import io
import itertools
import math
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.functions.values import nullify_tokens
from batchline.sources.delimited import Headed, union_matched

# Names of the public spreadsheet format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_EPOCH = datetime(1899, 12, 30)
_DATE_FORMATS = frozenset(range(14, 23)) | {45, 46, 47}

_BATCH = 4096
ROWS = "cells array<string>"


def _column_of(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as part:
        return [_text(e) for _, e in ElementTree.iterparse(part) if e.tag == f"{_MAIN}si"]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Positions of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(_DATE_FORMATS)
    for custom in styles.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.IGNORECASE):
            dated.add(int(custom.get("numFmtId")))
    formats = styles.find(f"{_MAIN}cellXfs")
    used = [] if formats is None else list(formats)
    return {i for i, xf in enumerate(used) if int(xf.get("numFmtId", 0)) in dated}


def _first_sheet(book: zipfile.ZipFile) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    wanted = root.find(f"{_MAIN}sheets")[0].get(_LINK)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _number(raw: str, is_date: bool) -> str:
    value = float(raw)
    if is_date:
        return str(_EPOCH + timedelta(milliseconds=round(value * 86_400_000)))
    if math.isfinite(value) and value == int(value):
        return str(int(value))
    return str(value)


def _cell(cell, strings: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return strings[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind == "n":
        return _number(value.text, int(cell.get("s", 0)) in dates)
    return value.text


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet, read as a stream; rows without any cell are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        with book.open(_first_sheet(book)) as part:
            for _, element in ElementTree.iterparse(part):
                if element.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for position, cell in enumerate(element.iter(f"{_MAIN}c")):
                    at = _column_of(cell.get("r")) if cell.get("r") else position
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _cell(cell, strings, dates)
                element.clear()
                if any(value is not None for value in row):
                    yield row


def _books(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str | None], Iterator[list[str | None]]]]:
    """Header and further rows of each workbook that has any."""
    for batch in batches:
        for content in batch["content"]:
            rows = sheet_rows(bytes(content)) if len(content) else iter(())
            header = next(rows, None)
            if header is not None:
                yield header, rows


def _frame(cells: list) -> pd.DataFrame:
    return pd.DataFrame({"cells": cells})


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for header, _ in _books(batches):
        yield _frame([header])


def _rows_under(wanted: list[str | None]):
    """Rows of the workbooks with one header, in small batches."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for header, rows in _books(batches):
            while header == wanted and (block := list(itertools.islice(rows, _BATCH))):
                yield _frame(block)

    return decode


def read_books(books: DataFrame) -> Iterator[Headed]:
    """One all-text frame per distinct header, with that header.

    ``books`` has the ``content`` of a workbook per row. The driver sees each distinct
    header once, however many workbooks there are.
    """
    books = books.select("content")
    for row in books.mapInPandas(_headers, ROWS).distinct().collect():
        names = tuple(name or f"Unnamed: {i}" for i, name in enumerate(row["cells"]))
        cells = books.mapInPandas(_rows_under(list(row["cells"])), ROWS)
        frame = cells.select(*[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(names))])
        yield nullify_tokens(frame), names


def read_workbooks(spark: SparkSession, paths: Sequence[str]) -> Iterator[Headed]:
    """Frames of the xlsx files at ``paths``."""
    return read_books(spark.read.format("binaryFile").load(list(paths)))


def load_workbooks(
    spark: SparkSession, paths: Sequence[str], comments: Mapping[str, str]
) -> DataFrame | None:
    """Rows of all workbooks under the table's column names."""
    return union_matched(read_workbooks(spark, paths), comments)
