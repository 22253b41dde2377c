"""Shared working folder: where loops cut their lineage and staged rows wait.

Everything is written through Spark or the Hadoop file system of the session, below the
folder named by ``spark.checkpoint.dir``, so that every executor sees it and a lost
executor costs a re-read, never a recomputation of the whole loop.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: For file streams: Spark passes over files that are older than this against the newest one seen,
#: after 7 days if nothing is said. No file is that old.
ANY_AGE = "365000d"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="batchline-")
    context.setCheckpointDir(root)
    return root


def new_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/batchline/{uuid.uuid4().hex}/{label}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Set SQL settings for eager work inside the block, then put the old ones back.

    Keys are written with ``__`` for ``.``.
    """
    names = {key.replace("__", "."): value for key, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def small_broadcasts(spark: SparkSession):
    """For eager work that joins again and again: broadcast only what is small in memory.

    Catalyst takes a file's size for that of its rows, but files of names are many times smaller, and
    every broadcast goes through the driver. Without this a loop over a graph of a million nodes sends
    most of its nodes there in every round. A table counts for ten times its files, and one of more than
    a megabyte is shuffled. Of a union of shuffled parts Spark 4.1 may then believe that it is dealt
    like each of them and fail with unequal numbers of partitions; it is told not to.
    """
    return settings(
        spark, spark__sql__autoBroadcastJoinThreshold="1MB", spark__sql__sources__fileCompressionFactor="10",
        spark__sql__unionOutputPartitioning="false",
    )


def nothing(spark: SparkSession, columns: str) -> DataFrame:
    """A frame of these columns without rows, known to Catalyst as empty."""
    return spark.sql("SELECT from_json(CAST(NULL AS string), :columns) AS r WHERE false", {"columns": columns}).select("r.*")


def _store(df: DataFrame, path: str, counted: str) -> int:
    """Write ``df`` and count on the way."""
    seen = Observation()
    df.observe(seen, F.count_if(F.expr(counted)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


class Scratch:
    """Intermediate parquet tables of one job.

    A table read back from here has an exact size, so Catalyst broadcasts it only when it
    is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = new_dir(spark, label)
        self.serial = 0
        self._stored: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, name: str, counted: str = "true") -> tuple[DataFrame, int]:
        """Write ``df`` once; return the table read back and its count of rows (``counted``)."""
        self.serial += 1
        path = f"{self.root}/{self.serial:04d}-{name}"
        size = _store(df, path, counted)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._stored.append((stored, path))
        return stored, size

    def forget(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing will read again; others are left alone."""
        files = FileSystem(self.spark)
        for stored, path in list(self._stored):
            if any(stored is table for table in tables):
                files.delete(path)
                self._stored.remove((stored, path))

    def close(self) -> None:
        """Delete everything saved here, the folder included."""
        FileSystem(self.spark).delete(self.root.rpartition("/")[0])
        self._stored.clear()

    def forget_all(self, *, but: tuple[DataFrame, ...] = ()) -> None:
        self.forget(*[t for t, _ in self._stored if not any(t is kept for kept in but)])


class Rounds:
    """A table that grows by one partition per round of a loop.

    However many rounds there are, reading it is one scan, so the plan does not grow.
    """

    def __init__(self, scratch: Scratch, name: str, columns: str, round_column: str):
        self._spark = scratch.spark
        self._path = f"{scratch.root}/{name}"
        self._columns, self._round = columns, round_column
        self._empty = True

    def add(self, df: DataFrame, number: int, counted: str = "true") -> tuple[DataFrame, int]:
        """Write one round; return it read back and its count of rows (``counted``)."""
        path = f"{self._path}/{self._round}={number}"
        size = _store(df, path, counted)
        self._empty = False
        return self._spark.read.schema(self._columns).parquet(path), size

    def since(self, number: int) -> DataFrame:
        """The rounds from ``number`` on; the others are not read."""
        return self.all().filter(F.col(self._round) >= number)

    def all(self) -> DataFrame:
        """All rounds so far, with the round's number as a column."""
        schema = f"{self._columns}, {self._round} int"
        if self._empty:
            return nothing(self._spark, schema)
        return self._spark.read.schema(schema).parquet(self._path)


class FileSystem:
    """The few file operations Spark SQL has no statement for, on any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def glob(self, pattern: str) -> list[str]:
        """Files (not folders) that match; nothing found gives an empty list."""
        statuses = self._fs(pattern).globStatus(self._path(pattern))
        found = [s for s in statuses or [] if s.isFile()]
        return [s.getPath().toString() for s in found]

    def children(self, path: str) -> list[str]:
        """What lies in a folder."""
        return [s.getPath().toString() for s in self._fs(path).listStatus(self._path(path))]

    def size(self, path: str) -> int:
        return self._fs(path).getFileStatus(self._path(path)).getLen()

    def start(self, path: str, most: int) -> bytes:
        """The first bytes of a file."""
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(stream.readNBytes(most))
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def put(self, path: str, text: str) -> None:
        """Write a small text file, replacing an old one; readers see it whole or not at all."""
        fs, partial = self._fs(path), self._path(f"{path}.partial")
        out = fs.create(partial, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(self._path(path), False)
        if not fs.rename(partial, self._path(path)):
            raise OSError(f"could not write {path}")

    def move(self, path: str, target: str) -> bool:
        """Rename; false when the file system refuses."""
        fs, destination = self._fs(path), self._path(target)
        fs.mkdirs(destination.getParent())
        return fs.rename(self._path(path), destination)

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
