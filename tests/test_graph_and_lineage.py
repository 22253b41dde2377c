from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from batchline.operators import documents, graph, lineage
from batchline.plans import schedule
from batchline.scratch import Scratch

EDGE = "target string, source string, rel string, script_name string, script_type string, update_mode string, schedule_frequency string, schedule_status boolean"
NODE = "en_name string, label string, type string, status boolean, schedule_frequency string, update_mode string, schedule_status boolean"


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def reachable(pairs, start):
    seen, stack = set(), [start]
    while stack:
        at = stack.pop()
        for a, b in pairs:
            if a == at and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def cycles(pairs):
    nodes = {n for p in pairs for n in p}
    reach = {n: reachable(pairs, n) for n in nodes}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


def random_pairs(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})


@pytest.mark.parametrize(("seed", "nodes", "edges"), [(1, 30, 35), (3, 40, 30)])
def test_components_and_levels_against_brute_force(spark, seed, nodes, edges):
    pairs = random_pairs(seed, nodes, edges)
    component = cycles(pairs)
    found = {r["node"]: r["component"] for r in graph.components(frame(spark, pairs)).collect()}
    assert found == component
    straight = [(a, b) for a, b in pairs if component.get(a) is None or component.get(a) != component.get(b)]
    level = {r["node"]: r["level"] for r in graph.levels(frame(spark, pairs), spark.range(nodes).selectExpr("CAST(id AS int) AS node")).collect()}
    assert set(level) == set(range(nodes))
    for node in range(nodes):
        needs = [level[b] for a, b in straight if a == node]
        assert level[node] == (1 + max(needs) if needs else 0)


@pytest.mark.parametrize("pairs", [
    [(0, 1), (1, 2), (2, 1)],  # a chain into a cycle
    [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5), (5, 1)],  # cycles in a row, and a loop before them
    [(i, (i + 1) % 16) for i in range(16)] + [(100 + i, 101 + i) for i in range(16)] + [(116, 0)],
])
def test_components_of_chains_and_cycles(spark, pairs):
    found = {r["node"]: r["component"] for r in graph.components(frame(spark, pairs)).collect()}
    assert found == cycles(pairs)


def test_labels_cross_a_long_cycle_in_few_rounds(spark):
    scratch = Scratch(spark, "long")
    n = 512
    labels = graph._spread_least(scratch, spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")).collect()
    assert len(labels) == n and len({r["label"] for r in labels}) == 1
    assert scratch.serial < 50  # tables written, two a round; one hop a round writes 512


def test_reach_against_brute_force(spark):
    pairs = random_pairs(7, 40, 50)
    seeds = [0, 1, 2]
    got = {r["node"]: r["depth"] for r in graph.reach(frame(spark, pairs), spark.createDataFrame([(s,) for s in seeds], "node int")).collect()}
    assert set(got) == set().union(*[reachable(pairs, s) for s in seeds])
    assert all(d == 1 for n, d in got.items() if any((s, n) in pairs for s in seeds))
    one = graph.reach(frame(spark, pairs), spark.createDataFrame([(0,)], "node int"), max_depth=1)
    assert {r["node"] for r in one.collect()} == {b for a, b in pairs if a == 0}


def test_hub_with_a_third_of_all_edges(spark):
    spokes = spark.range(20000).selectExpr("CAST(id + 10 AS int) AS src", "CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE id % 7 + 2 END AS int) AS dst")
    pairs = spokes.union(frame(spark, [(1, 0), (2, 1)]))
    got = graph.levels(pairs, spark.createDataFrame([(5000000,)], "node int"))
    assert {r["level"]: r["count"] for r in got.groupBy("level").count().collect()} == {
        0: 1 + 6 + 1, 1: 1 + _counted(range(20000), (3, 4, 5, 6, 7, 8)), 2: 1 + _counted(range(20000), (1,)), 3: _counted(range(20000), (2,)),
    }
    up = graph.reach(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([(0,)], "node int"))
    assert up.count() == 2 + _counted(range(20000), (1, 2))


def _counted(ids, targets):
    return sum(1 for i in ids if (1 if i % 3 == 0 else i % 7 + 2) in targets)


@pytest.fixture(scope="module")
def small_graph(spark):
    nodes = spark.createDataFrame(
        [
            ("src", "DataSource", None, True, None, None, None),
            ("res", "DataResource", None, None, "daily", None, True),
            ("file", "DataResource", "structure", True, "monthly", "full_refresh", True),
            ("m1", "DataModel", None, True, None, None, None),
            ("m2", "DataModel", None, True, None, None, None),
            ("bad", "DataModel", None, False, None, None, None),
            ("m3", "DataModel", None, True, None, None, None),
            ("odd", None, None, True, None, None, None),
            ("bare", "DataModel", None, True, None, None, None),
        ],
        NODE,
    )
    edges = spark.createDataFrame(
        [
            ("res", "src", "ORIGINATES_FROM", "pull.py", "python", "append", "daily", True),
            ("m1", "res", "DERIVED_FROM", "a.sql", "sql", None, "daily", False),
            ("m1", "file", "DERIVED_FROM", "a.sql", "sql", "append", "daily", False),
            ("m2", "m1", "DERIVED_FROM", "b.sql", None, "append", "weekly", True),
            ("m2", "m2", "DERIVED_FROM", "c.sql", "sql", "append", "weekly", True),
            ("bad", "m1", "DERIVED_FROM", "", "sql", "append", "daily", True),
            ("m3", "bad", "DERIVED_FROM", None, "sql", "append", "daily", True),
            ("odd", "m1", "USES", "o.sql", "sql", "append", "daily", True),
            ("bare", "m1", "USES", "x.sql", "sql", "append", "daily", True),
        ],
        EDGE,
    )
    return nodes, edges


def names(df, column="table_name"):
    return sorted(r[column] for r in df.collect())


def test_enabled(small_graph):
    assert names(lineage.enabled_targets(*small_graph)) == ["bad", "file", "m2", "m3", "res"]


def test_scripts_and_sources(small_graph):
    scripts, sources = lineage.table_scripts(*small_graph)
    got = {(r["target"], r["script_name"]): (r["n_sources"], r["schedule_frequency"]) for r in scripts.collect()}
    assert got[("m1", "a.sql")] == (2, "daily")
    assert got[("file", "load_file.py")] == (0, "monthly")
    assert got[("bad", "bad_script.py")] == (1, "daily")
    assert got[("odd", "o.sql")] == (1, "daily")
    assert got[("bare", "bare_script.py")] == (1, "daily")
    assert got[("src", "src_script.py")] == (0, "daily")
    assert ("m2", "c.sql", "m2") in {tuple(r) for r in sources.collect()}


def test_passive_one_hop_and_further(small_graph, spark):
    scheduled = spark.createDataFrame([("m2",)], "table_name string")
    one = {r["table_name"]: r for r in lineage.passive_tables(scheduled, *small_graph).collect()}
    assert set(one) == {"m2", "m1"}
    assert (one["m1"]["is_direct"], one["m1"]["schedule_frequency"], one["m1"]["script_name"]) == (False, "weekly", "b.sql")
    assert names(lineage.passive_tables(scheduled, *small_graph, max_depth=5)) == ["file", "m1", "m2", "res"]


def test_closure_needs_a_source_of_its_own(small_graph, spark):
    enabled = spark.createDataFrame([("m2",), ("file",)], "table_name string")
    assert [tuple(r) for r in lineage.closure_resources(enabled, *small_graph).collect()] == [("res", "append")]


@pytest.mark.parametrize(
    ("level", "chain"),
    [
        ("self", {("m2", 0)}),
        ("resource", {("m2", 0), ("m1", 1), ("res", 2), ("file", 2)}),
        ("source", {("m2", 0), ("m1", 1), ("res", 2), ("file", 2), ("src", 3)}),
    ],
)
def test_chain(small_graph, spark, level, chain):
    starts = spark.createDataFrame([("m2", "b.sql")], "table_name string, script_name string")
    got = lineage.script_chain(starts, *small_graph, level).collect()
    assert {(r["table_name"], r["depth"]) for r in got} == chain
    ids = {r["table_name"]: r["script_id"] for r in got}
    assert ids["m2"] == "b_sql_m2"
    if level != "self":
        assert ids["file"] == "load_file_py_file" and ids.get("src") is None


def test_invalid_both_ways(small_graph):
    nodes, edges = small_graph
    assert set(names(lineage.valid_tables(nodes, edges), "en_name")) == {"src", "res", "file", "m1", "m2", "odd", "bare"}
    assert set(names(lineage.valid_tables(nodes, edges, "upstream"), "en_name")) == {"src", "m2", "m3", "odd", "bare"}
    with pytest.raises(ValueError):
        lineage.valid_tables(nodes, edges, "sideways")


def test_dependencies(small_graph):
    nodes, edges = small_graph
    scripts, sources = lineage.table_scripts(nodes, edges)
    got = {tuple(r) for r in lineage.script_dependencies(scripts, sources, edges).collect()}
    assert ("b_sql_m2", "a_sql_m1") in got and ("c_sql_m2", "b_sql_m2") in got
    assert ("c_sql_m2", "c_sql_m2") not in got
    assert ("src_script_py_src", None) in got


def test_dependencies_fall_back_on_every_edge(spark, small_graph):
    _, edges = small_graph
    scripts = spark.createDataFrame([("m1", "x.sql"), ("m2", "y.sql")], "target string, script_name string")
    unrelated = spark.createDataFrame([("m1", "x.sql", "gone"), ("m2", "y.sql", "gone")], "target string, script_name string, source string")
    got = {tuple(r) for r in lineage.script_dependencies(scripts, unrelated, edges).collect()}
    assert got == {("y_sql_m2", "x_sql_m1"), ("x_sql_m1", None)}


def test_plan_of_a_day(small_graph):
    plans = schedule.plan_for(*small_graph, date(2024, 7, 7))
    read = F.from_json("plan", "exec_date string, script_dependencies map<string, array<string>>, resource_scripts array<string>").alias("p")
    rows = [(r["part"], r["script_id"], r["p"]) for r in plans.select("part", "script_id", read).collect()]
    assert {p["exec_date"] for _, _, p in rows} == {"2024-07-07"}
    assert sum(part == "plan" for part, _, _ in rows) == 1
    order = [r["script_id"] for r in documents.execution_order(plans).orderBy("place").collect()]
    assert order == ["load_file_py_file", "pull_py_res", "a_sql_m1", "b_sql_m2", "c_sql_m2"][1:]
    assert [p["script_dependencies"]["c_sql_m2"] for part, i, p in rows if (part, i) == ("wait", "c_sql_m2")] == [["b_sql_m2"]]
    assert [s for part, _, p in rows if part == "script" for s in p["resource_scripts"]] == ["pull_py_res"]


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z"), ("", 0, "z"), ("b", 3, "w")], "id string, at int, v string")
    assert sorted(map(tuple, lineage.keep_first(df, "id", ["at"]).collect())) == [("a", 1, "y"), ("b", 3, "w")]


def test_a_walk_broadcasts_only_what_is_small_in_memory(spark, monkeypatch):
    """Names of 300,000 nodes are a small file but not a small table."""
    from batchline import scratch

    plans, store = [], scratch._store

    def seen(df, path, counted):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, path, counted)

    monkeypatch.setattr(scratch, "_store", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    edges = spark.range(300_000).selectExpr("concat('n', id) AS src", "concat('m', id % 7) AS dst")
    found = graph.reach(edges, edges.selectExpr("src AS node"))
    assert found.count() == 7
    assert "SortMergeJoin" in plans[2] and "BroadcastHashJoin" not in plans[2]  # edges, seeds, the first round
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
