"""Session defaults used by the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", name: str = "batchline") -> SparkSession:
    """A local session; a cluster brings its own and none of this is required of it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
