"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.scratch import FileSystem, new_dir, settings

#: White space of the contracts: the ASCII characters 9 to 13 and 32.
BLANK = r"[\x20\x09-\x0D]+"


#: While a step is written: shuffle files go when it ends, and Python gets texts in small batches.
_WRITING = {
    "spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true",
    "spark__sql__execution__arrow__maxBytesPerBatch": "8m",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: the lineage ends at files that
    every executor sees, and the shuffle files behind it are given up at once."""
    spark = df.sparkSession
    path = f"{new_dir(spark, label)}/rows"
    with settings(spark, **_WRITING):
        df.write.options(**options).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def held(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` as a table of files with a place for each row: itself if it reads all parquet files
    of one folder and nothing else, or else a stored copy."""
    folders = {path.rpartition("/")[0] for path in docs.inputFiles()}
    if len(folders) == 1:
        # Spark compares relations by the folder as it was given: with scheme and authority or without
        parts = urlsplit(folders.pop())
        for folder in (parts.geturl(), f"{parts.scheme}://{parts.netloc}{parts.path}", f"{parts.scheme}:{parts.path}", parts.path):
            if docs.sparkSession.read.schema(docs.schema).parquet(folder).sameSemantics(docs):
                return docs
    return saved(docs, label)


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for stored in tables:
        FileSystem(stored.sparkSession).delete(stored.scratch_path)


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``most`` bytes; a longer text is a
    run of its own. No row is cut or left out."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    group = np.cumsum(sizes.astype(np.int64)) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for begin, end in zip(edges, edges[1:], strict=False):
        yield batch.slice(begin, end - begin)


def segments(lengths: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs begins, and the end of the last."""
    edges = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=edges[1:])
    return edges


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, .. of each run, one run after the other."""
    edges = segments(lengths)
    kind = np.int32 if edges[-1] < 1 << 31 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    out = np.arange(edges[-1], dtype=kind)
    out += np.repeat((starts - edges[:-1]).astype(kind), lengths)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor) over unsigned integers, elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x
