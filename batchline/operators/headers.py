"""Matching file headers to table columns."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class NoMatchingColumn(ValueError):
    """No header of a file names a column of its table."""


@dataclass(frozen=True)
class HeaderMatch:
    """``mapping`` is header to column in header order; the rest is to be warned about."""

    mapping: dict[str, str]
    unmatched_headers: tuple[str, ...]
    unmatched_columns: tuple[str, ...]


def column_comments(spark: SparkSession, table: str) -> dict[str, str]:
    """Column to comment in table order; a column without a comment stands for itself."""
    schema = spark.table(table).schema
    return {f.name: (f.metadata or {}).get("comment") or f.name for f in schema.fields}


def match_headers(headers: Sequence[str], comments: Mapping[str, str]) -> HeaderMatch:
    """Match by comment first, then by column name, both ignoring case.

    Each column is used once, in header order. Of equal comments the last column counts,
    of equal headers the position of the first and the spelling of the last.
    """
    spelled: dict[str, str] = {}
    for header in headers:
        spelled[header.lower()] = header
    by_comment = {(comment or name).lower(): name for name, comment in comments.items()}
    by_name = {name.lower(): name for name in comments}
    mapping: dict[str, str] = {}
    for candidates in (by_comment, by_name):
        for folded, header in spelled.items():
            column = candidates.get(folded)
            if header not in mapping and column is not None and column not in mapping.values():
                mapping[header] = column
    return HeaderMatch(
        mapping,
        tuple(h for h in headers if h not in mapping),
        tuple(c for c in comments if c not in mapping.values()),
    )


def select_matched(
    df: DataFrame, comments: Mapping[str, str], headers: Sequence[str] | None = None
) -> DataFrame:
    """The matched columns of ``df`` under their table names; no match is an error.

    ``headers`` are the file's headers for the columns of ``df`` in order (its own names by
    default): a file may repeat a name in another case, which a frame cannot.
    """
    headers = [h.strip() for h in headers or df.columns]
    match = match_headers(headers, comments)
    if not match.mapping:
        raise NoMatchingColumn(f"none of the headers {headers} names a column of {list(comments)}")
    if match.unmatched_headers or match.unmatched_columns:
        log.warning("not matched: headers %s, columns %s", match.unmatched_headers, match.unmatched_columns)
    return df.select(
        *[F.col(f"`{df.columns[headers.index(h)]}`").alias(c) for h, c in match.mapping.items()]
    )
