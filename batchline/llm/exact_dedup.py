"""Exact deduplication as a stream with keyed state on disk.

Documents arrive as files. The state, one entry per digest of the normalised text, is held by
the disk-backed state store and never expires: the least identifier seen so far, where that row's
content is (file and row), and the number of rows. Aggregation before the shuffle keeps a digest
that a third of all rows share at one entry per task. Each micro-batch writes the entries that
changed; the last of each digest is its state. Before anything is dropped, every hit's whole
normalised text is compared with the content at its entry's place; should a digest stand for two
texts, its rows are grouped by digest and text instead.

Normalised: each run of ASCII white space is one space; nothing is trimmed. Defined cases: null
text counts as empty; an empty table gives no rows; a null ``doc_id`` stays only if its group has
no other; of rows with equal text and equal ``doc_id`` the first by file and row stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchline.llm.common import BLANK, discard, held, saved
from batchline.scratch import ANY_AGE, new_dir, settings

#: Micro-batches that the files of a backlog are dealt to.
BATCHES = 3

_STATE = {
    "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true",
    "spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage": "true",
    "spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB": "200",
    # between batches the state is in the shared folder only: no local copy for each partition
    "spark__sql__streaming__stateStore__unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def sha256(text: Column) -> Column:
    """Digest of the normalised text, lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def _rows(source: DataFrame, digest) -> DataFrame:
    """``digest, at`` (order of preference, then place) and the normalised text of each row."""
    text = normalised(F.col("text"))
    place = F.struct(
        F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    return source.select(place.alias("at"), digest(text).alias("digest"), text.alias("normal"))


def remember(spark: SparkSession, path: str, schema: T.StructType, batches: int = BATCHES, digest=sha256, folder: str | None = None) -> DataFrame:
    """Run the stream over the files at ``path`` and return its state: ``digest, first, n``.

    With the ``folder`` of an earlier run, only files that it has not seen are read.
    """
    folder = folder or new_dir(spark, "dedup")
    files = len(spark.read.schema(schema).parquet(path).inputFiles())

    def write(entries: DataFrame, number: int) -> None:
        entries.write.mode("overwrite").parquet(f"{folder}/entries/batch={number}")  # a repeated batch writes the same

    # written as a pattern, the path may be one file as well as a folder
    pattern = f"{path[:-1]}[{path[-1]}]"
    options = {"maxFilesPerTrigger": max(1, math.ceil(files / batches)), "maxFileAge": ANY_AGE}
    source = spark.readStream.schema(schema).options(**options).parquet(pattern)
    state = _rows(source, digest).groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    with settings(spark, **_STATE):
        query = (
            state.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    entry = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
    if not files:
        return spark.createDataFrame([], state.schema)
    entries = spark.read.schema(entry).parquet(f"{folder}/entries")
    last = entries.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("e"))  # the stream's state
    return last.select("digest", "e.first", "e.n")


def decisions(spark: SparkSession, path: str, schema: T.StructType, batches: int = BATCHES, digest=sha256) -> DataFrame:
    """One row per row of the files at ``path``: ``at`` (with doc_id, file, row), ``digest``,
    ``first`` (the row that stays) and ``n`` (rows of the group)."""
    state = saved(remember(spark, path, schema, batches, digest), "state")
    read = _rows(spark.read.schema(schema).parquet(path), digest)
    # every hit against the content that its entry locates; only texts with a hit are kept
    several = saved(read.join(state.filter("n > 1").drop("n"), "digest"), "hits")
    content = several.filter("at = first").select("digest", F.col("normal").alias("content"))
    hits = several.filter("at <> first").select("digest", "normal")
    differing = hits.join(content, "digest").filter("normal <> content").select("digest").distinct()
    unlike = saved(differing, "collisions")
    discard(several)
    thin = read.drop("normal").join(state, "digest")
    if unlike.isEmpty():
        return thin
    texts = read.join(unlike, "digest", "left_semi")
    groups = texts.groupBy("digest", "normal").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    split = texts.join(groups, ["digest", "normal"]).select("digest", "at", "first", "n")
    return thin.join(unlike, "digest", "left_anti").unionByName(split)


def report(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row at ``path``."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    return decisions(spark, path, schema, batches).select(
        F.col("at.doc_id").alias("doc_id"), F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("first")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    spark = docs.sparkSession
    rows = held(docs, "arrived")
    if not rows.inputFiles():
        return rows
    path = rows.inputFiles()[0].rpartition("/")[0]
    schema = rows.select("doc_id", "text").schema
    dropped = decisions(spark, path, schema, batches).filter("at <> first")
    gone = saved(dropped.select(F.col("at.file").alias("gone_file"), F.col("at.row").alias("gone_row")), "dropped")
    placed = rows.select(F.struct("*").alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    here = (F.col("file") == F.col("gone_file")) & (F.col("row") == F.col("gone_row"))
    return placed.join(gone, here, "left_anti").select("doc.*")
