"""Sources, clean-up, sinks and transforms over the business tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date, datetime
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.fixtures import table, view, with_views
from batchline.functions import values
from batchline.functions.periods import naive
from batchline.operators.headers import select_matched
from batchline.plans import transforms
from batchline.plans.loads import copy_source
from batchline.plans.templates import run_statement, run_statements
from batchline.queries import scratch_table
from batchline.scratch import FileSystem, new_dir
from batchline.sinks import writes
from batchline.sinks.tables import create_like, create_table
from batchline.sources.database import window_scan
from batchline.sources.delimited import load_delimited, union_matched
from batchline.sources.discovery import find_files
from batchline.sources.workbook import read_books
from batchline.streaming.ingest import ingest

STAMP = datetime(2024, 5, 1, 12, 30)
STAMP_SQL = "TIMESTAMP '2024-05-01 12:30:00'"
COMMENTS = {"id": "编号", "name": "名称", "segment": "Segment", "note": "note"}

# customer_raw with a free text that needs quoting, for one customer in five with a line break
_DROPPED = """SELECT CAST(c_custkey AS string) AS id,
  CASE WHEN c_custkey % 7 = 0 THEN 'NULL' WHEN c_custkey % 7 = 1 THEN 'null' WHEN c_custkey % 7 = 2 THEN ''
       WHEN c_custkey % 7 = 3 THEN chr(92) || 'N' WHEN c_custkey % 7 = 4 THEN 'NA' ELSE c_name END AS name,
  c_mktsegment AS segment,
  CASE WHEN c_custkey % 5 = 0 THEN 'said "yes", then' || chr(10) || 'left' WHEN c_custkey % 5 = 1 THEN 'a, b' ELSE 'nan' END AS note
FROM {customer}"""
_TOKENS = "(chr(92) || 'N', '', 'NULL', 'null')"


def _csv(df: DataFrame, path: str, encoding: str = "UTF-8", header: bool = True) -> None:
    (
        df.write.option("header", header).option("escape", '"').option("emptyValue", "")
        .option("encoding", encoding).csv(path)
    )


def csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of customers dropped as two kinds of CSV files, read back and cleaned."""
    rows = spark.sql(_DROPPED, customer=table(spark, sf_dir, "customer"))
    drop = new_dir(spark, "drop")
    broken = F.col("note").contains("\n")
    _csv(rows.filter(broken).withColumnsRenamed({"id": "编号", "name": " 名称 "}), f"{drop}/a")
    _csv(rows.filter(~broken).select("note", "segment", F.col("name").alias("NAME"), F.col("id").alias("Id")), f"{drop}/b")
    paths = find_files(spark, drop, "*/*.csv")
    return load_delimited(spark, paths, COMMENTS)


def _headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for number, batch in enumerate(batches):
        if number == 0:
            yield pd.DataFrame({"value": ["id,name,note"]})
        yield batch


def csv_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dropped with quotes inside plain fields and quoted line breaks of both kinds."""
    drop = new_dir(spark, "drop")
    broken = F.when(F.col("c_custkey") % 2 == 0, "\n").otherwise("\r\n")
    line = F.format_string('%d,5" %s,"a ""b"",%s%d"', "c_custkey", "c_name", broken, "c_custkey")
    rows = table(spark, sf_dir, "customer").select(line.alias("value"))
    rows.mapInPandas(_headed, "value string").write.text(f"{drop}/lines")
    paths = [row["path"] for row in spark.read.format("binaryFile").load(f"{drop}/lines").select("path").collect()]
    return load_delimited(spark, paths, COMMENTS)


def csv_lone_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dropped with records that end in a carriage return, and quoted breaks of all kinds."""
    drop = new_dir(spark, "drop")
    kind = F.col("c_custkey") % 3
    broken = F.when(kind == 0, "\n").when(kind == 1, "\r\n").otherwise("\r")
    line = F.format_string('%d,%s,"a%sb, ""c"""', "c_custkey", "c_name", broken)
    rows = table(spark, sf_dir, "customer").select(line.alias("value"))
    rows.mapInPandas(_headed, "value string").write.option("lineSep", "\r").text(f"{drop}/lines")
    paths = [row["path"] for row in spark.read.format("binaryFile").load(f"{drop}/lines").select("path").collect()]
    return load_delimited(spark, paths, COMMENTS)


def csv_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dropped in three encodings."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_custkey")
    drop = new_dir(spark, "drop")
    for kind, (encoding, mark, headers) in enumerate(
        [("UTF-8", " 商é", ("编号", "名称")), ("GBK", " 商", ("编号", "名称")), ("ISO-8859-1", " é", ("ID", "NAME"))]
    ):
        some = customers.filter(F.col("c_custkey") % 3 == kind)
        named = some.select("id", F.concat("c_name", F.lit(mark))).toDF(*headers)
        _csv(named, f"{drop}/{kind}", encoding)
    return load_delimited(spark, find_files(spark, drop, "*/*.csv"), COMMENTS)


def _workbook(rows: list[tuple]) -> bytes:
    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f"<row>{''.join(cell(v) for v in row)}</row>" for row in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{link}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [("编号", "Name ", "segment"), *batch.itertuples(index=False, name=None)]
        yield pd.DataFrame({"content": [_workbook(rows)]})


def xlsx_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workbooks (one per batch of rows), decoded and cleaned."""
    rows = spark.sql(_DROPPED, customer=table(spark, sf_dir, "customer"))
    typed = rows.select(F.col("id").cast("bigint").alias("id"), "name", "segment")
    books = typed.mapInPandas(_workbooks, "content binary")
    return union_matched(read_books(books), COMMENTS)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dropped as files in two turns; the stream runs after each, and once more."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("编号"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("Segment")
    )
    drop, target = new_dir(spark, "drop"), scratch_table(spark, "ingested")
    create_table(
        spark, target, spark.createDataFrame([], "id bigint, name string, segment string, create_time timestamp_ntz, ingest_batch bigint").schema,
        ["ingest_batch"],
    )
    spark.sql(f"ALTER TABLE {target} CHANGE COLUMN id COMMENT '编号'")
    checkpoint = new_dir(spark, "checkpoint")
    for turn in (0, 1):
        _csv(rows.filter(F.crc32("name") % 2 == turn), f"{drop}/turn{turn}")
        ingest(spark, f"{drop}/turn*", target, checkpoint, stamp=STAMP)
    ingest(spark, f"{drop}/turn*", target, checkpoint, stamp=STAMP)
    return spark.table(target).select("id", "name", "segment", "create_time")


def stream_recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dropped in three turns under the same file names, each archived once loaded."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", F.col("c_mktsegment").alias("segment"))
    drop, archive, target = new_dir(spark, "drop"), new_dir(spark, "archive"), scratch_table(spark, "recurring")
    create_table(
        spark, target, spark.createDataFrame([], "id bigint, c_name string, segment string, create_time timestamp_ntz, ingest_batch bigint").schema,
        ["ingest_batch"],
    )
    checkpoint, files = new_dir(spark, "checkpoint"), FileSystem(spark)
    for turn in range(3):
        written = new_dir(spark, f"turn{turn}")
        _csv(rows.filter(F.col("id") % 3 == turn), written)
        for number, path in enumerate(find_files(spark, written, "*.csv")):
            files.move(path, f"{drop}/customers{number}.csv")
        ingest(spark, drop, target, checkpoint, archive=archive, relative="customers", stamp=STAMP)
    return spark.table(target).select("id", F.col("c_name").alias("name"), "segment", "create_time", (F.col("ingest_batch") >= 0).alias("batched"))


def full_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders copied into a table created like them, stamped."""
    target = scratch_table(spark, "copy")
    copy_source(table(spark, sf_dir, "orders"), target, "full_refresh", stamp=STAMP)
    return spark.table(target)


def window_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of orders copied, and copied again."""
    target = scratch_table(spark, "copy")
    for _ in range(2):
        copy_source(
            table(spark, sf_dir, "orders"), target, "replace_window", exec_date="1996-05-05",
            frequency="quarterly", column="o_orderdate", stamp=STAMP,
        )
    return spark.table(target).select("o_orderkey", "o_orderdate", "create_time")


def create_like_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created like customers takes their rows; the audit columns are empty."""
    source = table(spark, sf_dir, "customer")
    target = scratch_table(spark, "like")
    create_like(spark, source, target)
    writes.append(source, target)
    return spark.table(target)


_WINDOW = (date(1996, 1, 1), date(1996, 2, 1))


def window_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    found = window_scan(items, "L_SHIPDATE", *_WINDOW)
    return found.select("l_orderkey", "l_shipdate", "l_extendedprice", "l_discount")


def window_scan_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    found = window_scan(orders, "biz_date", *_WINDOW, on_missing="full_scan")
    return found.select("o_orderkey", "o_totalprice")


def header_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "customer_raw")
    headed = raw.select(
        F.col("segment").alias("SEGMENT"), F.col("id").alias(" Customer ID "),
        F.col("name").alias("Name"), F.lit("x").alias("Unknown"),
    )
    comments = {"id": "customer id", "name": "Full name", "segment": "Segment", "phone": "Phone"}
    return select_matched(values.trim_headers(headed), comments)


def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.nullify_tokens(view(spark, sf_dir, "customer_raw"))


def drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.drop_empty_rows(null_tokens(spark, sf_dir), ["id", "name", "segment"])


def audit_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return values.load_stamp(rows, naive(STAMP), ["c_custkey", "c_name", "created_at"])


def copy_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("create_time"))
    return values.copy_stamp(rows, naive(STAMP))


def append_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, then line items appended by name in another order and with fewer columns."""
    target = scratch_table(spark, "appended")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("O_TOTALPRICE"), F.col("l_orderkey").alias("o_orderkey")
    )
    create_table(spark, target, orders.schema)
    writes.append(orders, target)
    writes.append(items, target)
    return spark.table(target)


def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, then replaced by a projection of themselves read from the same table."""
    target = scratch_table(spark, "refreshed")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    create_table(spark, target, orders.schema)
    writes.write(orders, target, "append")
    doubled = spark.table(target).select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    writes.write(doubled, target, "full_refresh", staged=True)
    return spark.table(target)


_REPLACED = (date(1996, 1, 10), date(1996, 3, 20))


def window_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month; ten weeks are replaced, twice, by the large orders of those weeks.

    The window cuts through two months, empties none and leaves null dates alone.
    """
    target = scratch_table(spark, "windowed")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("biz_time"), "o_totalprice"
    ).withColumn("biz_month", F.trunc("biz_time", "month"))
    create_table(spark, target, orders.schema, ["biz_month"])
    writes.append(orders, target)
    large = orders.filter("o_totalprice > 200000").filter(writes.in_window(F.col("biz_time"), *_REPLACED))
    new = large.select("o_orderkey", "biz_time", (-F.col("o_totalprice")).alias("o_totalprice"))
    for _ in range(2):
        writes.replace_window(new, target, "biz_time", *_REPLACED, partition="biz_month", grain="month")
    return spark.table(target).select("o_orderkey", "biz_time", "o_totalprice")


def batch_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of orders; the first is loaded again with other values."""
    target = scratch_table(spark, "batches")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    shape = orders.withColumn("batch_date", F.lit(None).cast("date"))
    create_table(spark, target, shape.schema, ["batch_date"])
    first, second = date(2024, 5, 1), date(2024, 5, 2)
    writes.write(orders, target, "replace_batch", batch_date=first)
    writes.write(orders, target, "replace_batch", batch_date=second)
    negative = orders.withColumn("o_totalprice", -F.col("o_totalprice"))
    writes.write(negative, target, "replace_batch", batch_date=first)
    return spark.table(target)


_TEMPLATE = """
INSERT INTO ads.nation_revenue (nation, biz_month, orders, revenue)
SELECT n.n_name, CAST('{{ start_date }}' AS date), count(*), round(sum(o.o_totalprice), 2)
FROM batchline_t_orders o
JOIN batchline_t_customer c ON c.c_custkey = o.o_custkey
JOIN batchline_t_nation n ON n.n_nationkey = c.c_nationkey  -- every customer has one
WHERE o.o_orderdate >= '{{ start_date }}' AND o.o_orderdate < '{{ end_date }}'
GROUP BY n.n_name;
"""


def _register(spark: SparkSession, sf_dir: str) -> None:
    for name in ("orders", "customer", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"batchline_t_{name}")


def sql_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir)
    text = (
        "SELECT o_orderkey, o_totalprice FROM batchline_t_orders "
        "WHERE o_orderdate >= DATE '{{ start_date }}' AND o_orderdate < '{{ end_date }}' AND o_totalprice > {{ least }}"
    )
    return run_statement(spark, text, {"start_date": _WINDOW[0], "end_date": _WINDOW[1], "least": 1000.0})


def sql_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that starts with WITH is a query like any other."""
    _register(spark, sf_dir)
    return run_statement(
        spark,
        "WITH per AS (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent "
        "FROM batchline_t_orders GROUP BY o_custkey) "
        "SELECT c_mktsegment AS segment, count(*) AS customers, sum(orders) AS orders, round(sum(spent), 2) AS spent "
        "FROM per JOIN batchline_t_customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    )


def windowed_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored statement run for a month, stored as that date's batch, run again."""
    _register(spark, sf_dir)
    target = scratch_table(spark, "nation_revenue")
    for _ in range(2):
        df = transforms.sql_frame(spark, _TEMPLATE, "1996-03-17", "monthly")
        transforms.store(df, target, "1996-03-17", "monthly", "replace_batch")
    return spark.table(target).select("nation", "biz_month", "orders", "revenue", "batch_date")


def script_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored script from metadata to target: scheduled twice for March, then for April, then
    March again by hand, which replaces the month's rows whichever batch wrote them."""
    _register(spark, sf_dir)
    target = scratch_table(spark, "t").rpartition(".")[2]
    nodes = spark.createDataFrame([(target, "Revenue", "DataModel", "biz_month")], "en_name string, name string, label string, target_dt_column string")
    described = [("nation", "varchar(25)"), ("biz_month", "date"), ("orders", "bigint"), ("revenue", "double precision")]
    columns = spark.createDataFrame(
        [(target, i, name, kind, "", name == "nation") for i, (name, kind) in enumerate(described)],
        "table_name string, column_id int, en_name string, data_type string, name string, is_pk boolean",
    )
    text = "-- revenue by nation and month" + _TEMPLATE.replace("nation_revenue", target)
    scripts = spark.createDataFrame([(target, "revenue.sql", text, None)], "target_table string, script_name string, script_content string, target_dt_column string")
    for day, manual in (("1996-03-17", False), ("1996-03-17", False), ("1996-04-02", False), ("1996-03-30", True)):
        transforms.run_script(spark, nodes, columns, scripts, target, "revenue.sql", day, "monthly", "append", manual)
    return spark.table(f"ads.{target}").select("nation", "biz_month", "orders", "revenue", "batch_date")


def template_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers inside longer literals."""
    _register(spark, sf_dir)
    text = (
        "SELECT o_orderkey, 'from {{ start_date }} to {{ end_date }}' AS period FROM batchline_t_orders "
        "WHERE CAST(o_orderdate AS timestamp) >= TIMESTAMP '{{ start_date }}' AND CAST(o_orderdate AS timestamp) < CAST('{{ end_date }} 00:00:00' AS timestamp)"
    )
    return run_statement(spark, text, {"start_date": _WINDOW[0], "end_date": _WINDOW[1]})


def multi_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text that fills a table in two statements and reads it in a third."""
    _register(spark, sf_dir)
    target = scratch_table(spark, "several")
    create_table(spark, target, spark.createDataFrame([], "o_orderkey bigint, half string").schema)
    run_statements(
        spark,
        f"INSERT INTO {target} SELECT o_orderkey, 'first; half' FROM batchline_t_orders WHERE o_orderdate < '{{{{ start_date }}}}'; -- then; the rest\n"
        f"INSERT INTO {target} SELECT o_orderkey, 'second' FROM batchline_t_orders WHERE o_orderdate >= '{{{{ start_date }}}}';",
        {"start_date": _WINDOW[0]},
    )
    return spark.table(target)


def affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement of a text affected: two that insert, one that reads."""
    _register(spark, sf_dir)
    target = scratch_table(spark, "affected")
    create_table(spark, target, spark.createDataFrame([], "o_orderkey bigint, half string").schema)
    text = (
        f"INSERT INTO {target} (half, o_orderkey) SELECT 'first', o_orderkey FROM batchline_t_orders WHERE o_orderdate < '{{{{ start_date }}}}';"
        f"INSERT INTO {target} SELECT o_orderkey, 'second' FROM batchline_t_orders WHERE o_orderdate >= '{{{{ start_date }}}}';"
        f"SELECT * FROM {target} WHERE half = 'first'"
    )
    counts = run_statements(spark, text, {"start_date": _WINDOW[0]})
    stored = spark.table(target).groupBy("half").agg(F.count("*").alias("stored"))
    told = spark.createDataFrame(list(zip((1, 2, 3), ("first", "second", "first"), counts, strict=True)), "statement int, half string, affected bigint")
    return told.join(stored, "half").select("statement", "half", "affected", "stored")


def replace_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and a whole table published at once, each replaced by rows that it holds itself."""
    batches, whole = scratch_table(spark, "committed"), scratch_table(spark, "committed")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    create_table(spark, batches, orders.withColumn("batch_date", F.lit(None).cast("date")).schema, ["batch_date"])
    create_table(spark, whole, orders.schema)
    first, second = date(2024, 5, 1), date(2024, 5, 2)
    for day in (first, second):
        writes.write(orders, batches, "replace_batch", batch_date=day, staged=True)
    own = spark.table(batches).filter(F.col("batch_date") == first)
    writes.write(own.withColumn("o_totalprice", -F.col("o_totalprice")).drop("batch_date"), batches, "replace_batch", batch_date=first, staged=True)
    for factor in (1, 3, 2):
        source = orders if factor == 1 else spark.table(whole)
        writes.write(source.withColumn("o_totalprice", F.col("o_totalprice") * factor), whole, "full_refresh", staged=True)
    return spark.table(batches).unionByName(spark.table(whole), allowMissingColumns=True)


def key_checked_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in two halves by key; a third append that overlaps is refused."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    target = scratch_table(spark, "keyed")
    create_table(spark, target, orders.schema)
    for half in (0, 1):
        writes.append_checked(orders.filter(F.crc32(F.col("o_orderkey").cast("string")) % 2 == half), target, ["o_orderkey"])
    try:
        writes.append_checked(orders.filter("o_orderkey % 100 = 1"), target, ["o_orderkey"])
        refused = False
    except ValueError:
        refused = True
    return spark.table(target).withColumn("refused", F.lit(refused))


@transforms.python_transform("events_by_user.py")
def _events_by_user(spark: SparkSession, start: date, end: date, *, events: DataFrame) -> DataFrame:
    inside = window_scan(events, "ts", start, end)
    return inside.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"), F.max("ts").alias("last_ts")
    )


def python_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {"events": table(spark, sf_dir, "events")}
    target = scratch_table(spark, "events_by_user")
    df = transforms.python_frame(spark, "events_by_user.py", "2024-01-10", "weekly", params)
    transforms.store(df, target, "2024-01-10", "weekly", "replace_window", column="last_ts")
    return spark.table(target).select("user_id", "events", "value", "last_ts")


QUERIES = {
    "csv_load": csv_load,
    "csv_irregular": csv_irregular,
    "csv_lone_return": csv_lone_return,
    "csv_encoding": csv_encoding,
    "xlsx_load": xlsx_load,
    "stream_ingest": stream_ingest,
    "stream_recurring": stream_recurring,
    "full_copy": full_copy,
    "window_copy": window_copy,
    "create_like": create_like_query,
    "window_scan": window_scan_query,
    "window_scan_missing": window_scan_missing,
    "header_match": header_match,
    "null_tokens": null_tokens,
    "drop_empty_rows": drop_empty_rows,
    "audit_stamp": audit_stamp,
    "copy_stamp": copy_stamp,
    "append_load": append_load,
    "full_refresh": full_refresh,
    "window_replace": window_replace,
    "batch_replace": batch_replace,
    "sql_template": sql_template,
    "sql_select": sql_select,
    "script_run": script_run,
    "template_literal": template_literal,
    "multi_statement": multi_statement,
    "affected_rows": affected_rows,
    "replace_committed": replace_committed,
    "key_checked_append": key_checked_append,
    "windowed_transform": windowed_transform,
    "python_transform": python_transform,
}

_CLEAN = ", ".join(f"CASE WHEN {c} NOT IN {_TOKENS} THEN {c} END AS {c}" for c in ("id", "name", "segment"))
_AUDIT = f"{STAMP_SQL} AS create_time, CAST(NULL AS TIMESTAMP) AS update_time"
_DUCK_DROPPED = _DROPPED.replace("{customer}", "customer")
_IN_REPLACED = "biz_time >= DATE '1996-01-10' AND biz_time < DATE '1996-03-20'"

ORACLE = {
    "csv_load": f"WITH d AS ({_DUCK_DROPPED}) SELECT id, CASE WHEN name NOT IN {_TOKENS} THEN name END AS name, segment, note FROM d",
    "csv_irregular": "SELECT CAST(c_custkey AS string) AS id, '5\" ' || c_name AS name, "
    "'a \"b\",' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) ELSE chr(13) || chr(10) END || c_custkey AS note FROM customer",
    "csv_lone_return": "SELECT CAST(c_custkey AS string) AS id, c_name AS name, "
    "'a' || CASE c_custkey % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) ELSE chr(13) END || 'b, \"c\"' AS note FROM customer",
    "csv_encoding": "SELECT CAST(c_custkey AS string) AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' 商é' "
    "WHEN c_custkey % 3 = 1 THEN ' 商' ELSE ' é' END AS name FROM customer",
    "xlsx_load": f"WITH d AS ({_DUCK_DROPPED}) SELECT id, CASE WHEN name NOT IN {_TOKENS} THEN name END AS name, segment FROM d",
    "stream_ingest": f"SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, {STAMP_SQL} AS create_time FROM customer",
    "stream_recurring": f"SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, {STAMP_SQL} AS create_time, true AS batched FROM customer",
    "full_copy": f"SELECT *, {_AUDIT} FROM orders",
    "window_copy": f"SELECT o_orderkey, o_orderdate, {STAMP_SQL} AS create_time FROM orders "
    "WHERE o_orderdate >= DATE '1996-04-01' AND o_orderdate < DATE '1996-07-01'",
    "create_like": "SELECT *, CAST(NULL AS TIMESTAMP) AS create_time, CAST(NULL AS TIMESTAMP) AS update_time FROM customer",
    "window_scan": "SELECT l_orderkey, l_shipdate, l_extendedprice, l_discount FROM lineitem "
    "WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-02-01'",
    "window_scan_missing": "SELECT o_orderkey, o_totalprice FROM orders",
    "header_match": with_views(["customer_raw"], "SELECT id, name, segment FROM customer_raw"),
    "null_tokens": with_views(["customer_raw"], f"SELECT {_CLEAN} FROM customer_raw"),
    "drop_empty_rows": with_views(
        ["customer_raw"],
        f"SELECT * FROM (SELECT {_CLEAN} FROM customer_raw) WHERE id IS NOT NULL OR name IS NOT NULL OR segment IS NOT NULL",
    ),
    "audit_stamp": f"SELECT c_custkey, c_name, {STAMP_SQL} AS created_at FROM customer",
    "copy_stamp": f"SELECT o_orderkey, {_AUDIT} FROM orders",
    "append_load": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
    "UNION ALL SELECT l_orderkey, NULL, l_extendedprice FROM lineitem",
    "full_refresh": "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders",
    "window_replace": "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS biz_time, o_totalprice FROM orders) "
    f"SELECT * FROM t WHERE NOT coalesce({_IN_REPLACED}, false) "
    f"UNION ALL SELECT o_orderkey, biz_time, -o_totalprice FROM t WHERE o_totalprice > 200000 AND {_IN_REPLACED}",
    "batch_replace": "SELECT o_orderkey, -o_totalprice AS o_totalprice, DATE '2024-05-01' AS batch_date FROM orders "
    "UNION ALL SELECT o_orderkey, o_totalprice, DATE '2024-05-02' FROM orders",
    "sql_template": "SELECT o_orderkey, o_totalprice FROM orders "
    "WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-02-01' AND o_totalprice > 1000",
    "sql_select": "SELECT c_mktsegment AS segment, count(*) AS customers, CAST(sum(orders) AS bigint) AS orders, round(sum(spent), 2) AS spent "
    "FROM (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey) "
    "JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "windowed_transform": "SELECT n_name AS nation, DATE '1996-03-01' AS biz_month, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, "
    "DATE '1996-03-17' AS batch_date FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey "
    "WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-04-01' GROUP BY n_name",
    "script_run": " UNION ALL ".join(
        f"SELECT n_name AS nation, DATE '{first}' AS biz_month, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue, "
        f"DATE '{batch}' AS batch_date FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey "
        f"WHERE o_orderdate >= DATE '{first}' AND o_orderdate < DATE '{after}' GROUP BY n_name"
        for first, after, batch in (("1996-03-01", "1996-04-01", "1996-03-30"), ("1996-04-01", "1996-05-01", "1996-04-02"))
    ),
    "template_literal": "SELECT o_orderkey, 'from 1996-01-01 to 1996-02-01' AS period FROM orders "
    "WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-02-01'",
    "affected_rows": "WITH h AS (SELECT CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'first' ELSE 'second' END AS half, count(*) AS n FROM orders GROUP BY half) "
    "SELECT CAST(statement AS int) AS statement, half, n AS affected, n AS stored FROM (VALUES (1, 'first'), (2, 'second'), (3, 'first')) AS s(statement, half) JOIN h USING (half)",
    "replace_committed": "SELECT o_orderkey, -o_totalprice AS o_totalprice, DATE '2024-05-01' AS batch_date FROM orders "
    "UNION ALL SELECT o_orderkey, o_totalprice, DATE '2024-05-02' FROM orders UNION ALL SELECT o_orderkey, o_totalprice * 3 * 2, NULL FROM orders",
    "key_checked_append": "SELECT o_orderkey, o_custkey, o_totalprice, true AS refused FROM orders",
    "multi_statement": "SELECT o_orderkey, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'first; half' ELSE 'second' END AS half FROM orders",
    "python_transform": "SELECT user_id, count(*) AS events, round(sum(value), 4) AS value, max(ts) AS last_ts FROM events "
    "WHERE ts >= DATE '2024-01-08' AND ts < DATE '2024-01-15' GROUP BY user_id",
}
