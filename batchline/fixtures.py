"""Metadata, plan and run-log tables derived from the business tables.

One SQL text per view, valid in Spark SQL and DuckDB. ``with_views`` prefixes a query with
the ``WITH`` clause it needs, in dependency order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "nodes": """
SELECT p_partkey AS node_id, 't' || CAST(p_partkey AS string) AS en_name, p_name AS name,
  CASE WHEN p_partkey < 10 THEN 'DataSource' WHEN p_partkey < 50 THEN 'DataResource' ELSE 'DataModel' END AS label,
  CASE WHEN p_partkey >= 10 AND p_partkey < 50 AND p_partkey % 7 = 3 THEN 'structure' END AS type,
  CASE WHEN p_partkey % 97 = 60 THEN false WHEN p_partkey % 97 = 61 THEN CAST(NULL AS boolean) ELSE true END AS status,
  CASE WHEN p_partkey % 6 = 0 THEN 'daily' WHEN p_partkey % 6 = 1 THEN 'weekly' WHEN p_partkey % 6 = 2 THEN 'monthly'
       WHEN p_partkey % 6 = 3 THEN 'quarterly' WHEN p_partkey % 6 = 4 THEN 'yearly' END AS schedule_frequency,
  CASE WHEN p_partkey % 3 = 0 THEN 'full_refresh' WHEN p_partkey % 3 = 1 THEN 'append' END AS update_mode,
  p_size % 2 = 0 AS schedule_status,
  CASE WHEN p_partkey % 4 = 0 THEN 'biz_date' END AS target_dt_column
FROM part""",
    "edges": """
SELECT 't' || CAST(k AS string) AS target, 't' || CAST(s AS string) AS source, rel,
  CASE WHEN k % 8 <> 0 THEN 't' || CAST(k AS string) || '_process.' || CASE WHEN k % 3 = 0 THEN 'sql' ELSE 'py' END END AS script_name,
  CASE WHEN k % 3 = 0 THEN 'sql' WHEN k % 3 = 1 THEN 'python' WHEN k % 9 <> 2 THEN 'python_script' END AS script_type,
  CASE WHEN k % 5 = 0 THEN 'full_refresh' WHEN k % 5 = 1 THEN CAST(NULL AS string) ELSE 'append' END AS update_mode,
  CASE WHEN k % 4 = 0 THEN 'weekly' WHEN k % 4 = 1 THEN 'monthly' ELSE 'daily' END AS schedule_frequency,
  k % 3 <> 1 AS schedule_status
FROM (
  SELECT p_partkey AS k, p_partkey % 10 AS s, 'ORIGINATES_FROM' AS rel FROM part WHERE p_partkey >= 10 AND p_partkey < 50
  UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 2) AS bigint), 'DERIVED_FROM' FROM part WHERE p_partkey >= 50
  UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 3) AS bigint), 'DERIVED_FROM' FROM part WHERE p_partkey >= 50 AND p_partkey % 3 = 0
) e""",
    "edges_cyclic": """
SELECT target, source FROM edges
UNION ALL SELECT 't' || CAST(CAST(floor(p_partkey / 2) AS bigint) AS string), 't' || CAST(p_partkey AS string)
FROM part WHERE p_partkey >= 100 AND p_partkey % 50 = 0""",
    "scripts": """
SELECT DISTINCT target AS target_table, script_name,
  'INSERT INTO ads.' || target || ' SELECT o.o_orderdate AS biz_date, o.o_custkey AS cust FROM orders o WHERE '
  || CASE WHEN length(target) % 2 = 0 THEN 'DATE(o.o_orderdate)' ELSE 'o.o_orderdate' END
  || ' >= ' || chr(39) || '{{ start_date }}' || chr(39) || ' AND o.o_orderdate < ' || chr(39) || '{{ end_date }}' || chr(39) AS script_content,
  CASE WHEN schedule_status THEN 'biz_date' END AS target_dt_column
FROM edges WHERE rel = 'DERIVED_FROM' AND script_name IS NOT NULL""",
    "columns": """
SELECT n.en_name AS table_name, c.column_id, c.en_name, c.data_type, c.name, c.is_pk
FROM nodes n CROSS JOIN (VALUES (1, 'id', 'bigint', 'Key', true), (2, 'region', 'varchar(20)', 'Region', true),
  (3, 'amount', 'numeric(18,2)', 'Amount', false), (4, 'biz_date', 'date', CAST(NULL AS string), false)
) AS c(column_id, en_name, data_type, name, is_pk) WHERE n.label <> 'DataSource'""",
    "schedules": """
SELECT d.exec_date, f.schedule_frequency FROM (SELECT DISTINCT CAST(o_orderdate AS date) AS exec_date FROM orders) d
CROSS JOIN (VALUES ('daily'), ('weekly'), ('monthly'), ('quarterly'), ('yearly')) AS f(schedule_frequency)""",
    "exec_plans": """
SELECT 'dag' || CAST(o_orderkey % 3 AS string) AS dag_id, 'r' || CAST(o_orderkey AS string) AS run_id,
  o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) AS logical_date, CAST(o_orderdate AS date) AS exec_date,
  '{"version":"2.0",' || CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '"exec_date":"' || CAST(CAST(o_orderdate AS date) AS string) || '",' END
  || '"scripts":[{"script_id":"s' || CAST(o_custkey AS string) || '"}],"resource_scripts":'
  || CASE WHEN o_orderkey % 15 = 1 THEN '"bad"' ELSE '[]' END || ',"model_scripts":["s' || CAST(o_custkey AS string) || '"]}' AS plan,
  o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 1440) AS create_time
FROM orders""",
    "task_runs": """
SELECT 'dag_main' AS dag_id, 'run' || CAST(o_custkey % 50 AS string) AS run_id, CAST(o_orderdate AS date) AS execution_date,
  CASE WHEN o_orderkey % 5 = 0 THEN 'start_' ELSE 's' || CAST(o_orderkey AS string) || '.py-TO-' END || 't' || CAST(o_orderkey AS string) AS task_id,
  CASE WHEN o_orderkey % 5 = 1 THEN 'sql' WHEN o_orderkey % 5 = 2 THEN 'python' ELSE 'python_script' END AS script_type,
  CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'failed'
       WHEN o_orderstatus = 'O' THEN 'upstream_failed' ELSE 'skipped' END AS state,
  o_orderdate AS start_date,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL '1' SECOND * CAST(floor(o_totalprice % 7200) AS bigint) END AS end_date,
  CAST(1 + o_orderkey % 3 AS int) AS try_number
FROM orders""",
    "customer_raw": """
SELECT CASE WHEN c_custkey % 7 = 6 THEN '' ELSE CAST(c_custkey AS string) END AS id,
  CASE WHEN c_custkey % 7 = 0 THEN 'NULL' WHEN c_custkey % 7 = 1 THEN 'null' WHEN c_custkey % 7 = 2 THEN '' WHEN c_custkey % 7 = 3 THEN chr(92) || 'N'
       WHEN c_custkey % 7 = 4 THEN 'NA' WHEN c_custkey % 7 = 6 THEN '' ELSE c_name END AS name,
  CASE WHEN c_custkey % 7 = 6 THEN 'NULL' ELSE c_mktsegment END AS segment FROM customer""",
    # one row per planned script, its sources held in the row as in a plan document
    "plan_scripts": """
SELECT CAST(o_orderdate AS date) AS exec_date,
  CASE WHEN o_orderkey % 4 = 0 THEN 'load_file.py' WHEN o_orderkey % 4 = 1 THEN 'load.v2.py' ELSE 'step' || CAST(o_orderkey % 9 AS string) || '.sql' END AS script_name,
  'm' || CAST(o_orderkey AS string) AS target_table,
  'm' || CAST(o_orderkey % 97 AS string) AS source_a,
  CASE WHEN o_orderkey % 3 = 0 THEN 'c' || CAST(o_custkey AS string) END AS source_b,
  CASE WHEN o_orderkey % 5 = 0 THEN 'DataResource' ELSE 'DataModel' END AS target_table_label
FROM orders""",
}

BASE = {
    "nodes": "part", "edges": "part", "edges_cyclic": "part", "scripts": "part", "columns": "part",
    "schedules": "orders", "exec_plans": "orders", "task_runs": "orders", "plan_scripts": "orders",
    "customer_raw": "customer",
}

NEEDS = {
    "edges_cyclic": ("edges",),
    "scripts": ("edges",),
    "columns": ("nodes",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _closure(names) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for needed in (*_closure(NEEDS.get(name, ())), name):
            if needed not in ordered:
                ordered.append(needed)
    return ordered


def with_views(names, query: str, recursive: bool = False) -> str:
    """``query`` with the named views inlined as common table expressions."""
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _closure(names))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{parts}{query}" if query.lstrip().startswith(",") else f"{head}{parts}\n{query}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; its business table is bound under a name of its own."""
    base = BASE[name]
    bound = f"batchline_{base}"
    table(spark, sf_dir, base).createOrReplaceTempView(bound)
    return spark.sql(re.sub(rf"FROM {base}\b(?! o )", f"FROM {bound}", with_views([name], f"SELECT * FROM {name}")))
