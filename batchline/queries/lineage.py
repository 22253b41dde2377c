"""Lineage questions over the derived dependency tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchline.fixtures import view, with_views
from batchline.operators import documents, lineage
from batchline.plans import schedule


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges")


def _enabled_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("schedule_status").select(F.col("en_name").alias("table_name"))


def enabled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.enabled_targets(*_graph(spark, sf_dir))


def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.one_hop(*_graph(spark, sf_dir))


def script_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.scripts_of_edges(lineage.one_hop(*_graph(spark, sf_dir)))


def script_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.sources_of_scripts(lineage.one_hop(*_graph(spark, sf_dir)))


def any_edge_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here the tables whose edges have all lost their kind are the ones without a typed edge."""
    nodes, edges = _graph(spark, sf_dir)
    untyped = edges.withColumn("rel", F.when(F.col("script_name").isNotNull(), F.col("rel")))
    return lineage.fallback_sources(nodes, untyped)


def passive_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return lineage.passive_tables(_enabled_nodes(nodes), nodes, edges)


def closure_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return lineage.closure_resources(_enabled_nodes(nodes), nodes, edges)


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from every enabled script of the SQL kind."""
    nodes, edges = _graph(spark, sf_dir)
    starts = edges.filter("schedule_status AND script_type = 'sql' AND script_name IS NOT NULL").select(
        F.col("target").alias("table_name"), "script_name"
    )
    return lineage.script_chain(starts, nodes, edges, "resource")


def chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order to run the chains of all enabled scripts of the SQL kind by hand."""
    nodes, edges = _graph(spark, sf_dir)
    starts = edges.filter("schedule_status AND script_type = 'sql' AND script_name IS NOT NULL").select(
        F.col("target").alias("table_name"), "script_name"
    )
    return lineage.chain_order(starts, nodes, edges, "resource")


def invalid_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return lineage.valid_tables(nodes, edges, "downstream").select("en_name", "label", "status")


def invalid_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return lineage.valid_tables(nodes, edges, "upstream").select("en_name", "label", "status")


def script_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    scripts, sources = lineage.table_scripts(nodes, edges)
    return lineage.script_dependencies(scripts, sources, edges)


def deps_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return lineage.dependencies_within(_enabled_nodes(nodes), edges)


def pair_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of every table with the two tables that its number suggests, in either order."""
    nodes, edges = _graph(spark, sf_dir)
    half = F.concat(F.lit("t"), F.floor(F.col("node_id") / 2).cast("string"))
    third = F.concat(F.lit("t"), F.floor(F.col("node_id") / 3).cast("string"))
    pairs = nodes.select(F.col("en_name").alias("table1"), half.alias("table2")).union(
        nodes.select(third, "en_name")
    )
    return lineage.pair_relations(pairs.distinct(), nodes, edges)


def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.cycle_nodes(view(spark, sf_dir, "edges_cyclic"))


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _graph(spark, sf_dir)
    return lineage.dependency_levels(view(spark, sf_dir, "edges_cyclic"), nodes)


def roots_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return lineage.ends_of(nodes.select(F.col("en_name").alias("table_name")), edges)


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of all edges, concatenated in edge order, each script kept where it comes first."""
    _, edges = _graph(spark, sf_dir)
    chain = edges.select(F.col("script_name").alias("script_id"), "target", "source", "update_mode")
    return lineage.keep_first(chain, "script_id", ["target", "source"])


def _plan_rows(plans: DataFrame) -> DataFrame:
    """The content of plan documents, read back by the JSON reader."""
    plan = F.from_json(
        "plan",
        "exec_date string, version string, scripts array<struct<script_id:string, script_name:string, level:int>>, "
        "script_dependencies map<string, array<string>>, resource_scripts array<string>, model_scripts array<string>",
    )
    read = plans.select(plan.alias("p")).select("p.*")

    def row(kind: str, script: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), script.alias("script_id"), value.alias("value"))

    # a document has the lists that concern it
    lists = F.array(
        F.transform("scripts", lambda s: row("script", s["script_id"], s["script_name"])),
        F.transform("scripts", lambda s: row("level", s["script_id"], s["level"].cast("string"))),
        F.transform("resource_scripts", lambda s: row("resource", s, F.lit(""))),
        F.transform("model_scripts", lambda s: row("model", s, F.lit(""))),
        F.flatten(
            F.transform(
                F.map_entries("script_dependencies"),
                lambda e: F.transform(e["value"], lambda v: row("wait", e["key"], v)),
            )
        ),
    )
    rows = F.flatten(F.array_compact(lists))
    return read.select(F.concat_ws(" ", "exec_date", "version").alias("plan"), F.inline(rows))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of every date from the planned scripts."""
    planned = view(spark, sf_dir, "plan_scripts")
    scripts = planned.select(
        "exec_date", F.col("target_table").alias("script_id"), "script_name", "target_table",
        "target_table_label", F.length("target_table").alias("level"),
    )
    needs = planned.select("exec_date", F.col("target_table").alias("script_id"), F.col("source_a").alias("depends_on"))
    return documents.pack_plans(scripts, needs)


def json_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan documents per date from the planned scripts, and what they hold."""
    return _plan_rows(_packed(spark, sf_dir))


def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of every date's plan, from its documents."""
    return documents.execution_order(_packed(spark, sf_dir))


def plan_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of every plan: what a reader checks that it has the whole plan by."""
    head = F.from_json("plan", "script_count bigint, wait_count bigint").alias("head")
    return _packed(spark, sf_dir).filter("part = 'plan'").select("exec_date", head).select("exec_date", "head.*")


def daily_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a Sunday that ends a quarter, from metadata to documents, and what it holds."""
    return _plan_rows(schedule.plan_for(*_graph(spark, sf_dir), date(2024, 6, 30)))


QUERIES = {
    "enabled_union": enabled_union,
    "one_hop": one_hop,
    "script_group": script_group,
    "script_sources": script_sources,
    "any_edge_fallback": any_edge_fallback,
    "passive_expand": passive_expand,
    "closure_resources": closure_resources,
    "bfs_levels": bfs_levels,
    "chain_order": chain_order,
    "invalid_downstream": invalid_downstream,
    "invalid_upstream": invalid_upstream,
    "script_deps": script_deps,
    "deps_in_set": deps_in_set,
    "pair_relation": pair_relation,
    "cycle_nodes": cycle_nodes,
    "topo_levels": topo_levels,
    "roots_leaves": roots_leaves,
    "dedupe_first": dedupe_first,
    "json_pack": json_pack,
    "plan_order": plan_order,
    "plan_heads": plan_heads,
    "daily_plan": daily_plan,
}


_ENABLED = (
    "SELECT target AS table_name FROM edges e JOIN nodes n ON n.en_name = target WHERE e.schedule_status "
    "AND ((label = 'DataModel' AND rel = 'DERIVED_FROM') OR (label = 'DataResource' AND rel = 'ORIGINATES_FROM')) "
    "UNION SELECT en_name FROM nodes WHERE label = 'DataResource' AND type = 'structure' AND schedule_status"
)
_HOPS = (
    "SELECT target, label, source, script_name, script_type, e.update_mode, e.schedule_frequency, e.schedule_status "
    "FROM edges e JOIN nodes n ON n.en_name = target "
    "WHERE (label = 'DataModel' AND rel = 'DERIVED_FROM') OR (label = 'DataResource' AND type IS NULL AND rel = 'ORIGINATES_FROM') OR label = 'DataSource' "
    "UNION ALL SELECT en_name, label, NULL, 'load_file.py', 'python_script', coalesce(update_mode, 'append'), "
    "coalesce(schedule_frequency, 'daily'), coalesce(schedule_status, true) FROM nodes WHERE label = 'DataResource' AND type = 'structure'"
)
_NAMED = f", hops AS ({_HOPS}), named AS (SELECT * REPLACE (coalesce(script_name, target || '_script.py') AS script_name) FROM hops) "
# every table's script and its sources, with the default script of tables without any edge
_SCRIPTS = (
    _NAMED + ", pairs AS (SELECT DISTINCT target, script_name, source FROM named "
    "UNION SELECT en_name, en_name || '_script.py', NULL FROM nodes WHERE en_name NOT IN (SELECT target FROM named)), "
    "ids AS (SELECT DISTINCT target, script_name, replace(script_name, '.', '_') || '_' || target AS script_id FROM pairs), "
    "needs AS (SELECT target, script_name, source FROM pairs WHERE source IS NOT NULL UNION "
    "SELECT p.target, p.script_name, e.source FROM pairs p JOIN edges e ON e.target = p.target WHERE p.source IS NULL), "
    "deps AS (SELECT DISTINCT a.script_id, b.script_id AS depends_on FROM needs n JOIN ids a USING (target, script_name) "
    "JOIN ids b ON b.target = n.source WHERE a.script_id <> b.script_id) "
)

# steps from scripts to those that they need, and the walk from the enabled scripts of the SQL kind
_WALK = (
    f", hops AS ({_HOPS}), named AS (SELECT * FROM hops WHERE label <> 'DataSource' AND script_name IS NOT NULL), "
    "first AS (SELECT target, min(script_name) AS script_name FROM named GROUP BY target), "
    "starts AS (SELECT DISTINCT target, script_name FROM edges WHERE schedule_status AND script_type = 'sql' AND script_name IS NOT NULL), "
    "step AS (SELECT DISTINCT n.target, n.script_name, f.target AS next_target, f.script_name AS next_script FROM named n JOIN first f ON f.target = n.source), "
    "walk AS (SELECT target, script_name, 0 AS depth FROM starts UNION "
    "SELECT s.next_target, s.next_script, depth + 1 FROM walk w JOIN step s ON s.target = w.target AND s.script_name = w.script_name)"
)


def _valid(ends: str) -> str:
    return with_views(
        ["nodes", "edges"],
        ", within AS (SELECT e.target, e.source FROM edges e JOIN nodes n ON n.en_name = e.target AND n.label = 'DataModel' "
        "WHERE e.rel = 'DERIVED_FROM' AND e.source IN (SELECT en_name FROM nodes)), "
        "hit AS (SELECT en_name FROM nodes WHERE status = false UNION "
        f"{ends}) SELECT en_name, label, status FROM nodes WHERE en_name NOT IN (SELECT en_name FROM hit)",
        recursive=True,
    )


_PAIRS = ", up AS (SELECT target AS a, source AS b FROM edges_cyclic UNION SELECT up.a, e.source FROM up JOIN edges_cyclic e ON e.target = up.b) "

ORACLE = {
    "enabled_union": with_views(["nodes", "edges"], _ENABLED),
    "one_hop": with_views(["nodes", "edges"], _HOPS),
    "script_group": with_views(
        ["nodes", "edges"],
        f"{_NAMED} SELECT target, script_name, count(DISTINCT source) AS n_sources, "
        "nullif(arg_min(coalesce(script_type, '~'), coalesce(source, '')), '~') AS script_type, "
        "nullif(arg_min(coalesce(update_mode, '~'), coalesce(source, '')), '~') AS update_mode, "
        "arg_min(schedule_frequency, coalesce(source, '')) AS schedule_frequency, "
        "arg_min(schedule_status, coalesce(source, '')) AS schedule_status FROM named GROUP BY target, script_name",
    ),
    "script_sources": with_views(
        ["nodes", "edges"], f"{_NAMED} SELECT DISTINCT target, script_name, source FROM named WHERE source IS NOT NULL"
    ),
    "any_edge_fallback": with_views(
        ["nodes", "edges"],
        ", typed AS (SELECT DISTINCT target FROM edges JOIN nodes n ON n.en_name = target WHERE script_name IS NOT NULL OR label = 'DataSource'), "
        "bare AS (SELECT en_name FROM nodes WHERE type IS NULL AND en_name NOT IN (SELECT target FROM typed)) "
        "SELECT DISTINCT en_name AS target, source, en_name || '_script.py' AS script_name, 'python_script' AS script_type, 'append' AS update_mode, "
        "'daily' AS schedule_frequency, true AS schedule_status FROM bare LEFT JOIN edges ON target = en_name",
    ),
    "passive_expand": with_views(
        ["nodes", "edges"],
        ", direct AS (SELECT * FROM nodes WHERE schedule_status), "
        "via AS (SELECT e.*, row_number() OVER (PARTITION BY e.source ORDER BY e.target, e.script_name NULLS FIRST) AS place FROM edges e "
        "JOIN direct d ON d.en_name = e.target AND d.label = 'DataModel' WHERE rel = 'DERIVED_FROM' AND e.source NOT IN (SELECT en_name FROM direct)) "
        "SELECT en_name AS table_name, label, status, schedule_frequency, update_mode, schedule_status, CAST(NULL AS string) AS script_name, "
        "CAST(NULL AS string) AS script_type, true AS is_direct FROM direct "
        "UNION ALL SELECT n.en_name, n.label, n.status, coalesce(v.schedule_frequency, n.schedule_frequency), coalesce(v.update_mode, n.update_mode), "
        "coalesce(v.schedule_status, n.schedule_status), v.script_name, v.script_type, false FROM via v JOIN nodes n ON n.en_name = v.source WHERE place = 1",
    ),
    "closure_resources": with_views(
        ["nodes", "edges"],
        ", found AS (SELECT source AS t FROM edges JOIN nodes n ON n.en_name = target AND n.schedule_status WHERE rel = 'DERIVED_FROM' "
        "UNION SELECT e.source FROM found JOIN edges e ON e.target = t AND e.rel = 'DERIVED_FROM') "
        "SELECT t AS table_name, 'append' AS execution_mode FROM found JOIN nodes n ON n.en_name = t AND n.label = 'DataResource' "
        "WHERE t IN (SELECT target FROM edges WHERE rel = 'ORIGINATES_FROM' AND source IN (SELECT en_name FROM nodes WHERE label = 'DataSource'))",
        recursive=True,
    ),
    "bfs_levels": with_views(
        ["nodes", "edges"],
        f"{_WALK} SELECT target AS table_name, script_name, min(depth) AS depth, replace(script_name, '.', '_') || '_' || target AS script_id "
        "FROM walk GROUP BY target, script_name",
        recursive=True,
    ),
    "chain_order": with_views(
        ["nodes", "edges"],
        f"{_WALK}, members AS (SELECT DISTINCT target, script_name FROM walk), "
        "lv AS (SELECT target, script_name, 0 AS place FROM members UNION "
        "SELECT s.target, s.script_name, place + 1 FROM lv JOIN step s ON s.next_target = lv.target AND s.next_script = lv.script_name "
        "JOIN members m ON m.target = s.target AND m.script_name = s.script_name), "
        "r AS (SELECT max(place) AS place, target AS table_name, script_name, replace(script_name, '.', '_') || '_' || target AS script_id FROM lv GROUP BY target, script_name) "
        "SELECT *, row_number() OVER (ORDER BY place, script_id, table_name, script_name) AS step FROM r",
        recursive=True,
    ),
    "invalid_downstream": _valid("SELECT w.target FROM hit JOIN within w ON w.source = hit.en_name"),
    "invalid_upstream": _valid("SELECT w.source FROM hit JOIN within w ON w.target = hit.en_name"),
    "script_deps": with_views(
        ["nodes", "edges"], f"{_SCRIPTS} SELECT DISTINCT ids.script_id, depends_on FROM ids LEFT JOIN deps ON deps.script_id = ids.script_id"
    ),
    "deps_in_set": with_views(
        ["nodes", "edges"],
        ", s AS (SELECT en_name FROM nodes WHERE schedule_status) SELECT DISTINCT s.en_name AS table_name, e.source AS depends_on FROM s "
        "LEFT JOIN (SELECT * FROM edges WHERE rel = 'DERIVED_FROM' AND source IN (SELECT en_name FROM s)) e ON e.target = s.en_name",
    ),
    "pair_relation": with_views(
        ["nodes", "edges"],
        ", p AS (SELECT en_name AS table1, 't' || CAST(node_id // 2 AS string) AS table2 FROM nodes "
        "UNION SELECT 't' || CAST(node_id // 3 AS string), en_name FROM nodes), "
        "k AS (SELECT target, source, min(script_name) AS script FROM edges WHERE rel = 'DERIVED_FROM' "
        "AND target IN (SELECT en_name FROM nodes WHERE label = 'DataModel') AND source IN (SELECT en_name FROM nodes WHERE label = 'DataModel') GROUP BY target, source) "
        "SELECT p.table1, p.table2, f.target IS NOT NULL AS forward_exists, f.script AS forward_script, b.target IS NOT NULL AS backward_exists, "
        "b.script AS backward_script FROM p LEFT JOIN k f ON f.target = p.table1 AND f.source = p.table2 "
        "LEFT JOIN k b ON b.target = p.table2 AND b.source = p.table1",
    ),
    "cycle_nodes": with_views(
        ["edges_cyclic"],
        f"{_PAIRS} SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM up x JOIN up y ON y.a = x.b AND y.b = x.a GROUP BY x.a",
        recursive=True,
    ),
    "topo_levels": with_views(
        ["nodes", "edges_cyclic"],
        f"{_PAIRS}, straight AS (SELECT DISTINCT target, source FROM edges_cyclic e WHERE NOT EXISTS (SELECT 1 FROM up WHERE a = e.source AND b = e.target)), "
        "lv AS (SELECT en_name AS t, 0 AS level FROM (SELECT en_name FROM nodes UNION SELECT source FROM edges_cyclic UNION SELECT target FROM edges_cyclic) "
        "UNION SELECT s.target, level + 1 FROM lv JOIN straight s ON s.source = lv.t) "
        "SELECT t AS table_name, max(level) AS level FROM lv GROUP BY t",
        recursive=True,
    ),
    "roots_leaves": with_views(
        ["nodes", "edges"],
        ", i AS (SELECT * FROM edges WHERE source IN (SELECT en_name FROM nodes)), "
        "r AS (SELECT en_name AS table_name, en_name NOT IN (SELECT target FROM i) AS is_root, en_name NOT IN (SELECT source FROM i) AS is_leaf FROM nodes) "
        "SELECT * FROM r WHERE is_root OR is_leaf",
    ),
    "dedupe_first": with_views(
        ["edges"],
        "SELECT script_name AS script_id, target, source, update_mode FROM edges WHERE script_name IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY script_name ORDER BY target, source) = 1",
    ),
    "json_pack": with_views(
        ["plan_scripts"],
        ", p AS (SELECT CAST(exec_date AS string) || ' 2.0' AS plan, * FROM plan_scripts) "
        "SELECT plan, 'script' AS kind, target_table AS script_id, script_name AS value FROM p "
        "UNION ALL SELECT plan, 'level', target_table, CAST(length(target_table) AS string) FROM p "
        "UNION ALL SELECT plan, CASE WHEN target_table_label = 'DataResource' THEN 'resource' ELSE 'model' END, target_table, '' FROM p "
        "UNION ALL SELECT plan, 'wait', target_table, source_a FROM p",
    ),
    "plan_order": with_views(
        ["plan_scripts"],
        "SELECT exec_date, target_table AS script_id, row_number() OVER (PARTITION BY exec_date ORDER BY length(target_table), target_table) AS place FROM plan_scripts",
    ),
    "plan_heads": with_views(
        ["plan_scripts"], "SELECT exec_date, count(*) AS script_count, count(source_a) AS wait_count FROM plan_scripts GROUP BY exec_date"
    ),
    "daily_plan": with_views(
        ["nodes", "edges"],
        f"{_SCRIPTS}, attrs AS (SELECT target, arg_min(schedule_frequency, (script_name, coalesce(source, ''))) AS frequency FROM named GROUP BY target), "
        f"enabled AS ({_ENABLED}), "
        "due AS (SELECT table_name AS t FROM enabled LEFT JOIN attrs ON target = table_name WHERE coalesce(frequency, 'daily') <> 'yearly'), "
        "wanted AS (SELECT t FROM due UNION SELECT e.source FROM edges e JOIN due ON t = e.target JOIN nodes n ON n.en_name = t AND n.label = 'DataModel' "
        "JOIN nodes m ON m.en_name = e.source WHERE rel = 'DERIVED_FROM'), "
        "hit AS (SELECT t FROM wanted JOIN nodes ON en_name = t WHERE status = false UNION SELECT e.target FROM hit JOIN edges e ON e.source = hit.t "
        "JOIN wanted w ON w.t = e.target JOIN nodes n ON n.en_name = e.target AND n.label = 'DataModel' WHERE rel = 'DERIVED_FROM'), "
        "planned AS (SELECT w.t, n.label FROM wanted w JOIN nodes n ON n.en_name = w.t WHERE w.t NOT IN (SELECT t FROM hit)), "
        "s AS (SELECT ids.*, label FROM ids JOIN planned ON t = target), "
        "w AS (SELECT * FROM deps WHERE script_id IN (SELECT script_id FROM s) AND depends_on IN (SELECT script_id FROM s)), "
        "lv AS (SELECT script_id, 0 AS level FROM s UNION SELECT w.script_id, level + 1 FROM lv JOIN w ON w.depends_on = lv.script_id) "
        "SELECT '2024-06-30 2.0' AS plan, 'script' AS kind, script_id, script_name AS value FROM s "
        "UNION ALL SELECT '2024-06-30 2.0', 'level', script_id, CAST(max(level) AS string) FROM lv GROUP BY script_id "
        "UNION ALL SELECT '2024-06-30 2.0', CASE WHEN label = 'DataResource' THEN 'resource' ELSE 'model' END, script_id, '' FROM s WHERE label <> 'DataSource' "
        "UNION ALL SELECT '2024-06-30 2.0', 'wait', script_id, depends_on FROM w",
        recursive=True,
    ),
}
