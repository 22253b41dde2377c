"""Registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from batchline.scratch import shared_dir


def scratch_table(spark: SparkSession, label: str) -> str:
    """A table name in a database of this application, stored below the shared folder."""
    application = "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId)
    database = f"batchline_{application}"
    location = f"{shared_dir(spark)}/batchline/{application}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    return f"{database}.{label}_{uuid.uuid4().hex[:12]}"
