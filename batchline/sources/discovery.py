"""Finding dropped files."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from batchline.scratch import FileSystem

# The extensions that are looked for, and what each is read with.
EXTENSIONS = (".csv", ".xlsx", ".xls")
READERS = {".csv": "delimited", ".xlsx": "workbook"}


def search_patterns(location: str) -> list[str]:
    """Glob patterns of a storage location relative to the upload folder."""
    location = location.lstrip("/")
    if re.search(r"\.[a-zA-Z0-9]+$", location):
        return [location]
    stem = location.rstrip("/")
    if not stem.endswith("*"):
        stem += "/*"
    return [stem + extension for extension in EXTENSIONS]


def find_files(spark: SparkSession, base: str, location: str) -> list[str]:
    """Matching files, each once and in name order; none found is an empty list."""
    files = FileSystem(spark)
    found: set[str] = set()
    for pattern in search_patterns(location):
        found.update(files.glob(f"{base.rstrip('/')}/{pattern}"))
    return sorted(found)


def by_reader(paths: list[str]) -> dict[str, list[str]]:
    """Paths per reader; a file without a reader is an error."""
    groups: dict[str, list[str]] = {}
    for path in paths:
        extension = "." + path.rsplit(".", 1)[-1].lower()
        if extension not in READERS:
            raise ValueError(f"no reader for {path}")
        groups.setdefault(READERS[extension], []).append(path)
    return groups
