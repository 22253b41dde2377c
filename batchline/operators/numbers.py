"""Running numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchline.scratch import Scratch


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Add the running number (from 1) of each row within its ``keys`` in the given order.

    The rows are range-sorted over all tasks and stored with their range, so that even a key with
    a third of all rows is numbered piece by piece: counts per key and range give each piece its
    first number.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    stored, _ = Scratch(rows.sparkSession, "numbered").save(ranged, "rows")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    numbers = stored.withColumn("_within", within).join(first, [*keys, "_range"])
    return numbers.withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within", "_range")
