"""Creating target tables: like a source, or from metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The audit columns of every target, the layers, and the types that metadata
# may name with the Spark type of each.
AUDIT_COLUMNS = ("create_time", "update_time")
RESOURCE_LAYER, MODEL_LAYER = "ods", "ads"
TYPE_NAMES = {
    "varchar": "STRING", "character varying": "STRING", "text": "STRING", "char": "STRING",
    "character": "STRING", "bpchar": "STRING", "int2": "SMALLINT", "smallint": "SMALLINT",
    "int4": "INT", "int": "INT", "integer": "INT", "int8": "BIGINT", "bigint": "BIGINT",
    "numeric": "DECIMAL", "decimal": "DECIMAL", "float4": "FLOAT", "real": "FLOAT",
    "float8": "DOUBLE", "double precision": "DOUBLE", "bool": "BOOLEAN", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamp without time zone": "TIMESTAMP_NTZ",
    "timestamptz": "TIMESTAMP", "timestamp with time zone": "TIMESTAMP",
    "json": "VARIANT", "jsonb": "VARIANT",
}
DEFAULT_DECIMAL = "(38,18)"


def quoted(name: str) -> str:
    """A table name, with or without a database, quoted part by part."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def with_audit_columns(schema: T.StructType) -> T.StructType:
    """The schema plus the audit columns it lacks; names compare without case."""
    present = {f.name.lower() for f in schema.fields}
    added = [T.StructField(c, T.TimestampNTZType()) for c in AUDIT_COLUMNS if c not in present]
    return T.StructType([*schema.fields, *added])


def create_table(
    spark: SparkSession, table: str, schema: T.StructType, partition_by: Sequence[str] = (),
    comment: str | None = None, primary_key: Sequence[str] = (),
) -> bool:
    """Create a parquet table unless it exists; false (and no change) if it does.

    Spark has no primary keys on such tables: the key is kept as the property ``pk`` for
    ``duplicate_keys``.
    """
    if spark.catalog.tableExists(table):
        return False
    lines = [f"{quoted(f.name)} {f.dataType.simpleString()}{_comment(f)}" for f in schema.fields]
    text = f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(lines)}) USING parquet"
    if partition_by:
        text += f" PARTITIONED BY ({', '.join(quoted(c) for c in partition_by)})"
    if comment:
        text += f" COMMENT {_literal(comment)}"
    if primary_key:
        text += f" TBLPROPERTIES ('pk' = {_literal(','.join(sorted(set(primary_key))))})"
    spark.sql(text)
    return True


def _comment(field: T.StructField) -> str:
    comment = (field.metadata or {}).get("comment")
    return f" COMMENT {_literal(comment)}" if comment else ""


def _literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_like(
    spark: SparkSession, source: DataFrame, table: str, partition_by: Sequence[str] = ()
) -> bool:
    """Create a table with the columns of ``source`` and the audit columns."""
    if not source.columns:
        raise ValueError(f"the source of {table} has no columns")
    return create_table(spark, table, with_audit_columns(source.schema), partition_by)


#: Partition column of a target that is loaded by windows, and where it keeps what it holds.
WINDOW_PART = "window_part"
_WINDOW_COLUMN, _WINDOW_GRAIN = "window.column", "window.grain"


def create_window_target(
    spark: SparkSession, source: DataFrame, table: str, column: str, grain: str
) -> bool:
    """Like ``create_like``, partitioned by the window's date truncated to ``grain``.

    The table remembers column and grain, so that later loads of any window, whatever its
    length, rewrite only the partitions that it touches.
    """
    shape = source.selectExpr("*", f"CAST(NULL AS date) AS {WINDOW_PART}")
    created = create_like(spark, shape, table, [WINDOW_PART])
    if created:
        known = next(c for c in source.columns if c.lower() == column.lower())
        spark.sql(
            f"ALTER TABLE {quoted(table)} SET TBLPROPERTIES "
            f"('{_WINDOW_COLUMN}' = {_literal(known)}, '{_WINDOW_GRAIN}' = '{grain}')"
        )
    return created


def window_layout(spark: SparkSession, table: str) -> tuple[str, str] | None:
    """Column and grain of a target made by ``create_window_target``; null for any other."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted(table)}").collect()  # a handful
    found = {r["key"]: r["value"] for r in rows}
    return (found[_WINDOW_COLUMN], found[_WINDOW_GRAIN]) if _WINDOW_GRAIN in found else None


def spark_type(name: str) -> str:
    """The Spark type of a type name in metadata; an unknown one is an error."""
    text = " ".join(name.strip().lower().split())
    if text.endswith("[]"):
        return f"ARRAY<{spark_type(text[:-2])}>"
    base, _, rest = text.partition("(")
    size, _, suffix = rest.partition(")")
    found = TYPE_NAMES.get(f"{base.strip()}{' ' + suffix.strip() if suffix.strip() else ''}")
    if found is None:
        raise ValueError(f"unknown column type: {name}")
    if found == "DECIMAL":
        return f"DECIMAL({size.replace(' ', '')})" if size else f"DECIMAL{DEFAULT_DECIMAL}"
    return found


def spark_type_column(name: Column) -> Column:
    """The same as an expression over a column of type names."""
    text = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    element = F.regexp_replace(text, r"(\[\])+$", "")
    base = F.trim(F.regexp_replace(element, r"\s*\([^)]*\)\s*", " "))
    size = F.replace(F.regexp_extract(element, r"\(([^)]*)\)", 1), F.lit(" "), F.lit(""))
    known = F.create_map(*[F.lit(part) for pair in TYPE_NAMES.items() for part in pair])
    found = F.try_element_at(known, base)
    sized = (
        F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown column type: "), name)).cast("string"))
        .when(found != "DECIMAL", found)
        .when(size == "", F.lit(f"DECIMAL{DEFAULT_DECIMAL}"))
        .otherwise(F.concat(F.lit("DECIMAL("), size, F.lit(")")))
    )
    depth = ((F.length(text) - F.length(element)) / 2).cast("int")
    return F.concat(F.repeat(F.lit("ARRAY<"), depth), sized, F.repeat(F.lit(">"), depth))


def table_ddl(nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """The create statement of every described table: ``table_name, layer, ddl, pk``.

    ``columns`` has ``table_name, column_id, en_name, data_type, name, is_pk``. Columns come
    in id order, then the audit columns that are absent; ``pk`` lists the key columns by
    name. The columns of a table are gathered, as its statement holds them.
    """
    note = F.when(F.col("name") != "", F.concat(F.lit(" COMMENT '"), _escaped("name"), F.lit("'")))
    line = F.concat(
        F.lit("`"), "en_name", F.lit("` "), spark_type_column(F.col("data_type")),
        F.coalesce(note, F.lit("")),
    )
    grouped = columns.select("*", line.alias("line")).groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("column_id", "line"))).alias("lines"),
        F.collect_set(F.lower("en_name")).alias("present"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_pk"), F.col("en_name")))), ", ").alias("pk"),
    )
    audit = F.filter(
        F.array(*[F.lit(c) for c in AUDIT_COLUMNS]), lambda c: ~F.array_contains(F.col("present"), c)
    )
    body = F.concat(
        F.transform("lines", lambda x: x["line"]),
        F.transform(audit, lambda c: F.concat(F.lit("`"), c, F.lit("` TIMESTAMP_NTZ"))),
    )
    described = nodes.select(
        F.col("en_name").alias("table_name"), F.col("name").alias("title"),
        F.when(F.col("label") == "DataResource", RESOURCE_LAYER).otherwise(MODEL_LAYER).alias("layer"),
    )
    title = F.when(F.col("title") != "", F.concat(F.lit(" COMMENT '"), _escaped("title"), F.lit("'")))
    ddl = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS `"), "layer", F.lit("`.`"), "table_name", F.lit("` (\n  "),
        F.array_join(body, ",\n  "), F.lit("\n) USING parquet"), F.coalesce(title, F.lit("")),
    )
    return grouped.join(described, "table_name").select("table_name", "layer", ddl.alias("ddl"), "pk")


def _escaped(column: str) -> Column:
    doubled = F.replace(F.col(column), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("'"), F.lit("\\'"))


def create_from_metadata(
    spark: SparkSession, nodes: DataFrame, columns: DataFrame, table: str, batch_column: str | None = None
) -> bool:
    """Create one described table in its layer; an undescribed one is an error.

    With ``batch_column`` it also gets that date column and is partitioned by it.
    """
    one = nodes.filter((F.col("en_name") == table) & (F.col("label") != "DataSource"))
    row = table_ddl(one, columns.filter(F.col("table_name") == table)).head()
    if row is None:
        raise LookupError(f"metadata does not describe {table}")
    layer, name = row["layer"], row["table_name"]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{layer}`")
    if spark.catalog.tableExists(f"{layer}.{name}"):
        return False
    ddl, head = row["ddl"], "\n) USING parquet"
    if batch_column:
        ddl = ddl.replace(head, f",\n  {quoted(batch_column)} DATE{head} PARTITIONED BY ({quoted(batch_column)})", 1)
    spark.sql(ddl)
    if row["pk"]:
        spark.sql(f"ALTER TABLE `{layer}`.`{name}` SET TBLPROPERTIES ('pk' = {_literal(row['pk'])})")
    return True


def duplicate_keys(df: DataFrame, primary_key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*primary_key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
