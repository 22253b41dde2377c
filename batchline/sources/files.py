"""Files of any known kind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from batchline.sources.delimited import load_delimited
from batchline.sources.discovery import by_reader
from batchline.sources.workbook import load_workbooks

_LOADERS = {"delimited": load_delimited, "workbook": load_workbooks}


def load_files(
    spark: SparkSession, paths: Sequence[str], comments: Mapping[str, str]
) -> DataFrame | None:
    """Rows of files under the table's column names; null if the files hold nothing."""
    rows = None
    for reader, group in sorted(by_reader(list(paths)).items()):
        frame = _LOADERS[reader](spark, group, comments)
        if frame is not None:
            rows = frame if rows is None else rows.unionByName(frame, allowMissingColumns=True)
    return rows
