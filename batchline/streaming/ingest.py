"""File drops, incrementally: every version of a file once, then archived.

A ledger holds the versions (path, modification time, length) that were loaded and are still in
the drop; new is what the listing holds and the ledger does not, by an anti-join. So a name that
recurs after its file was archived is loaded again, a file is never too old, and the ledger does not
grow with every file that ever came: when a run ends it is cut down to what the drop still holds.

Files are handed to the batch reader, so encodings and headers may differ from file to file. A batch
overwrites its own partition of the target, then enters its files in the ledger, then archives them,
then counts as done. A run that begins after a failure finishes the batch that was entered but not
done, and only archives; a batch that was not entered is formed anew under its number. So a failure
leaves neither a duplicate nor a gap. A file that is gone before it was loaded is an error: what is
there is loaded first.

One run at a time may work on a checkpoint. A file that is replaced in the drop by another of the
same length within the resolution of the file system's clock is not seen as new.
"""

from __future__ import annotations

import json
import logging
import time
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.functions.periods import naive
from batchline.functions.values import load_stamp
from batchline.operators.headers import column_comments
from batchline.scratch import FileSystem, nothing
from batchline.sinks.tables import quoted
from batchline.sinks.writes import aligned, partition_columns
from batchline.sources.files import load_files

log = logging.getLogger(__name__)

BATCH_COLUMN = "ingest_batch"
_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_VERSION = ["path", "modificationTime", "length"]
_ENTRY = "path string, modificationTime timestamp, length bigint"


def archive_path(archive: str, relative: str, day: date, path: str, stamp: int) -> str:
    """``<archive>/<folder>/<date>/<stem>_<unix time><extension>``."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    if not dot or not stem:
        stem, dot, extension = name, "", ""
    folder = "/".join(part for part in (archive.rstrip("/"), relative.strip("/"), day.isoformat()) if part)
    return f"{folder}/{stem}_{stamp}{dot}{extension}"


def archive_files(
    spark: SparkSession, paths: list[str], archive: str, relative: str, now: datetime | None = None
) -> list[str]:
    """Move loaded files away; one that cannot be moved is logged, the load stands.

    A name that is taken in the archive gets the next free second.
    """
    files, now = FileSystem(spark), now or datetime.now()
    begun, moved = int(time.mktime(now.timetuple())), []
    for path in paths:
        stamp = begun
        try:
            while files.exists(target := archive_path(archive, relative, now.date(), path, stamp)):
                stamp += 1
            if files.move(path, target):
                moved.append(target)
                continue
        except Exception:  # noqa: BLE001 - any file system error leaves the load in place
            log.exception("could not archive %s", path)
        log.error("could not archive %s", path)
    return moved


class Ledger:
    """Versions of files that were loaded, below a folder: one entry per batch, in generations.

    A small state file names the generation and the last batch that is done.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), FileSystem(spark)
        state = f"{self.root}/state"
        found = json.loads("".join(r["value"] for r in spark.read.text(state).collect())) if self.files.exists(state) else {}
        self.generation, self.done = found.get("generation", 0), found.get("done", -1)

    def _folder(self, generation: int) -> str:
        return f"{self.root}/ledger/{generation}"

    def _entry(self, batch: int) -> str:
        return f"{self._folder(self.generation)}/batch={batch}"

    def _put(self) -> None:
        self.files.put(f"{self.root}/state", json.dumps({"generation": self.generation, "done": self.done}))

    def entries(self) -> DataFrame:
        """All entries: every batch that was entered, done or not."""
        folder = self._folder(self.generation)
        if not self.files.exists(folder):
            return nothing(self.spark, _ENTRY)
        return self.spark.read.schema(f"{_ENTRY}, batch bigint").parquet(folder).drop("batch")

    def enter(self, batch: int, versions: list[tuple]) -> None:
        entry = self.spark.createDataFrame(versions, _ENTRY).coalesce(1)
        entry.write.mode("overwrite").parquet(self._entry(batch))

    def entered(self, batch: int) -> DataFrame | None:
        """The versions of a batch; none if it was not entered."""
        path = self._entry(batch)
        return self.spark.read.schema(_ENTRY).parquet(path) if self.files.exists(f"{path}/_SUCCESS") else None

    def finish(self, batch: int) -> None:
        self.done = batch
        self._put()

    def compact(self, listed: DataFrame) -> None:
        """Keep the versions that are still listed, as one entry of a new generation."""
        kept = self.entries().join(listed, _VERSION, "left_semi")
        kept.hint("rebalance").write.mode("overwrite").parquet(f"{self._folder(self.generation + 1)}/batch={self.done}")
        old, self.generation = self._folder(self.generation), self.generation + 1
        self._put()
        self.files.delete(old)


def _listed(spark: SparkSession, drop: str, pattern: str) -> DataFrame:
    """The versions of files in the drop."""
    try:
        found = spark.read.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).load(drop)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND" or not any(c in drop for c in "*?[{"):
            raise
        return nothing(spark, _ENTRY)  # folders that are named by a pattern need not be there yet
    return found.select(*_VERSION)


def ingest(
    spark: SparkSession, drop: str, table: str, checkpoint: str, *, pattern: str = "*.csv",
    archive: str | None = None, relative: str = "", stamp: datetime | None = None,
    files_per_batch: int = 1000,
) -> int:
    """Load every new version of a file below ``drop`` into ``table`` and stop; return the batches
    run, one that only had to be archived included.

    Raises ``FileNotFoundError`` once for files that vanished before they were loaded.

    ``table`` is partitioned by ``ingest_batch``. ``checkpoint`` holds the ledger: keep it with the
    table, for batch numbers start again without it.
    """
    if partition_columns(spark, table) != [BATCH_COLUMN]:
        raise ValueError(f"{table} is not partitioned by {BATCH_COLUMN}")
    comments = {c: n for c, n in column_comments(spark, table).items() if c != BATCH_COLUMN}
    ledger, files, batches = Ledger(spark, checkpoint), FileSystem(spark), 0

    def archive_and_finish(batch: int, paths: list[str]) -> None:
        nonlocal batches
        if archive is not None:
            archive_files(spark, sorted(paths), archive, relative)
        ledger.finish(batch)
        batches += 1

    batch = ledger.done + 1
    if (entered := ledger.entered(batch)) is not None:
        # only versions that are still there: a newer file of that name is not what was loaded
        left = entered.join(_listed(spark, drop, pattern), _VERSION, "left_semi")
        archive_and_finish(batch, [row["path"] for row in left.collect()])
    while True:
        new = _listed(spark, drop, pattern).join(ledger.entries(), _VERSION, "left_anti")
        # at most files_per_batch rows, the oldest first
        versions = [tuple(row) for row in new.orderBy("modificationTime", "path").limit(files_per_batch).collect()]
        if not versions:
            break
        batch = ledger.done + 1
        present = [v for v in versions if files.exists(v[0])]
        rows = load_files(spark, [v[0] for v in present], comments) if present else None
        if rows is not None:
            stamped = load_stamp(rows, naive(stamp or datetime.now()), list(comments))
            target = spark.table(table).drop(BATCH_COLUMN)
            spark.sql(
                f"INSERT OVERWRITE TABLE {quoted(table)} PARTITION ({BATCH_COLUMN} = {int(batch)}) "
                "SELECT * FROM {rows}",
                rows=aligned(stamped, target),
            )
        ledger.enter(batch, present)
        if len(present) < len(versions):
            gone = sorted(v[0] for v in set(versions) - set(present))
            raise FileNotFoundError(f"gone before they were loaded: {gone}")
        archive_and_finish(batch, [v[0] for v in present])
    if batches:
        ledger.compact(_listed(spark, drop, pattern))
    return batches
