"""Row-level clean-up and the defaults, labels and ids of metadata rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Texts that mean null in a dropped file.
NULL_TOKENS = ("\\N", "", "NULL", "null")

# Defaults of a script that metadata does not describe, and the loader that
# serves tables filled from dropped files.
DEFAULT_SCRIPT_TYPE = "python_script"
DEFAULT_UPDATE_MODE = "append"
DEFAULT_FREQUENCY = "daily"
FILE_LOADER = "load_file.py"

# Labels in order of precedence.
LABELS = ("DataModel", "DataResource", "DataSource")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def nullify_tokens(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null where a text column holds exactly one of the null tokens."""
    chosen = [c for c, kind in df.dtypes if kind == "string" and (columns is None or c in columns)]
    return df.withColumns(
        {c: F.when(F.col(c).isin(*NULL_TOKENS), None).otherwise(F.col(c)) for c in chosen}
    )


def drop_empty_rows(
    df: DataFrame, mapped: Sequence[str], dropped: Observation | None = None
) -> DataFrame:
    """Drop rows that are null in every mapped column.

    ``dropped`` receives the count as ``empty_rows`` when the result is written.
    """
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in mapped])
    if dropped is not None:
        df = df.observe(dropped, F.count_if(empty).alias("empty_rows"))
    return df.filter(~empty)


def load_stamp(df: DataFrame, stamp: Column, table_columns: Sequence[str]) -> DataFrame:
    """Stamp loaded rows: ``create_time`` if the table has it, else ``created_at``, else nothing."""
    for name in ("create_time", "created_at"):
        if name in table_columns:
            return df.withColumn(name, stamp)
    return df


def copy_stamp(df: DataFrame, stamp: Column) -> DataFrame:
    """Stamp copied rows: ``create_time`` always, an empty ``update_time`` only if absent."""
    df = df.withColumn("create_time", stamp)
    if "update_time" in [c.lower() for c in df.columns]:
        return df
    return df.withColumn("update_time", F.lit(None).cast("timestamp_ntz"))


def layer_of(labels: Column) -> Column:
    """Warehouse layer of a node: ``ods`` for resources, ``ads`` for everything else."""
    is_resource = F.coalesce(F.array_contains(labels, "DataResource"), F.lit(False))
    return F.when(is_resource, "ods").otherwise("ads")


def main_label(labels: Column) -> Column:
    """The first known label in order of precedence, else null."""
    return F.coalesce(*[F.when(F.array_contains(labels, name), name) for name in LABELS])


def script_defaults(df: DataFrame, table_column: str = "target") -> DataFrame:
    """Fill what metadata leaves out of a script row. An empty script name counts as missing."""
    own_name = F.concat(F.col(table_column), F.lit("_script.py"))
    return df.withColumns(
        {
            "script_name": F.coalesce(F.nullif(F.col("script_name"), F.lit("")), own_name),
            "script_type": F.coalesce(F.col("script_type"), F.lit(DEFAULT_SCRIPT_TYPE)),
            "update_mode": F.coalesce(F.col("update_mode"), F.lit(DEFAULT_UPDATE_MODE)),
            "schedule_frequency": F.coalesce(F.col("schedule_frequency"), F.lit(DEFAULT_FREQUENCY)),
            "schedule_status": F.coalesce(F.col("schedule_status"), F.lit(True)),
        }
    )


def file_stem(name: Column) -> Column:
    """A file name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^./]*$", "$1")


def task_id(script_name: Column, sources: Column, target: Column) -> Column:
    """Task id of a script row whose source tables are an array in the row."""
    stem = file_stem(script_name)
    plain = F.concat(stem, F.lit("_"), target)
    joined = F.concat(
        stem, F.lit("_"), F.array_join(F.array_sort(sources), "_"), F.lit("_to_"), target
    )
    has_sources = F.coalesce(F.size(sources) > 0, F.lit(False))
    is_loader = F.lower(script_name) == FILE_LOADER
    return F.when(is_loader | ~has_sources, plain).otherwise(joined)


def script_id(script_name: Column, target: Column) -> Column:
    """Script id: the script name with dots as underscores, then the target."""
    name = F.replace(F.coalesce(script_name, F.lit("")), F.lit("."), F.lit("_"))
    return F.concat(name, F.lit("_"), target)
