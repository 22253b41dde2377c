"""The task log as a stream: start and end events in any order and any batches, folded per task.

State is one row per task (date, target table, script), on disk and without expiry: the last
start and the last end seen so far, each with the time of the batch that brought it. It is kept by
Spark's own streaming aggregate, so no event passes through Python. An event that changes neither
leaves the older batch's time and gives no row, so files that are delivered again, or starts that
come after a later one, cost nothing downstream. What changed in a batch becomes the batch's own
folder of the log, overwritten when the batch is repeated; a reader takes the last row of each task.

The result is that of ``operators.runlog.fold_task_log`` over all events, however they are cut into
files and batches: the greatest ``written`` of a kind wins, of equal ones the greatest time, then
duration, then success; null comes before any value. Dates may come as dates or as their texts, one
task under both. A null in the key is a key of its own; an event of another kind is ignored, but its
task has a row. No files give an empty log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchline.scratch import ANY_AGE, FileSystem, nothing, settings

KEY = ("exec_date", "target_table", "script_name")
EVENTS = (
    "exec_date string, target_table string, script_name string, kind string, event_time timestamp_ntz, "
    "written bigint, success boolean, duration double"
)
LOG = (
    "exec_date date, target_table string, script_name string, exec_start_time timestamp_ntz, "
    "exec_end_time timestamp_ntz, exec_duration double, exec_result boolean"
)
_STORE = {
    "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# times travel as microseconds since 1970 on the clock they were read from, whatever the session's zone
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_ROW = "exec_date date, target_table string, script_name string, started bigint, ended bigint, duration double, success boolean"


def _last(kind: str, *values: str) -> Column:
    """The greatest event of a kind, null first as Spark sorts; of equal ones that of the oldest batch.

    Events of other kinds count as nulls, so that whoever has a row has both structs.
    """
    own = [F.when(F.col("kind") == kind, F.col(c)).alias(c) for c in ("written", *values)]
    return F.max(F.struct(*own, (-F.col("batch_time")).alias("age")))


def fold_stream(
    spark: SparkSession, events: str, folder: str, *, schema: str | T.StructType = EVENTS, files_per_batch: int = 1000
) -> DataFrame:
    """Fold the event files (parquet) below ``events`` that no earlier run has seen, stop, and return
    the whole log.

    ``folder`` holds the checkpoint and the log; give the same one again to go on. ``schema`` is that
    of the files; its ``exec_date`` may be a date.
    """
    folder = folder.rstrip("/")
    source = spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, maxFileAge=ANY_AGE).parquet(events)
    micros = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, event_time)")
    # one time for all of a batch, kept with its offsets: a repeated batch has the same
    batch_time = F.unix_micros(F.current_timestamp()).alias("batch_time")
    keyed = source.select(
        F.to_date("exec_date").alias("exec_date"), "target_table", "script_name", "kind",
        micros.alias("event_time"), F.col("written").cast("bigint").alias("written"), "duration", "success", batch_time,
    )
    folded = keyed.groupBy(*KEY).agg(
        _last("start", "event_time").alias("start"), _last("end", "event_time", "duration", "success").alias("end")
    )
    by_this_batch = -F.unix_micros(F.current_timestamp())
    changed = folded.filter((F.col("start.age") == by_this_batch) | (F.col("end.age") == by_this_batch)).select(
        *KEY, F.col("start.event_time").alias("started"), F.col("end.event_time").alias("ended"), "end.duration", "end.success"
    )

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")  # a repeated batch writes the same

    with settings(spark, **_STORE):
        query = (
            changed.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return task_log(spark, folder)


def task_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log so far: the last row of each task."""
    path = f"{folder.rstrip('/')}/log"
    if not FileSystem(spark).exists(path):
        return nothing(spark, LOG)
    rows = spark.read.schema(f"{_ROW}, batch bigint").parquet(path)
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("started", "ended", "duration", "success"), "batch").alias("last"))

    def clock(micros: str) -> Column:
        return F.expr(f"timestampadd(MICROSECOND, {micros}, {_EPOCH})")

    return last.select(
        *KEY, clock("last.started").alias("exec_start_time"), clock("last.ended").alias("exec_end_time"),
        F.col("last.duration").alias("exec_duration"), F.col("last.success").alias("exec_result"),
    )
