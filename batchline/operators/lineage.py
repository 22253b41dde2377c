"""Questions about tables, their sources and the scripts between them.

``nodes`` has one row per table: ``en_name, label, type, status, schedule_frequency,
update_mode, schedule_status, ...``. ``edges`` has ``target, source, rel, script_name,
script_type, update_mode, schedule_frequency, schedule_status``: *target depends on source*.

Results are relations in long form (one row per table, script or dependency), never one
array per group, so that a table read by a third of all scripts stays divisible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchline.functions.values import FILE_LOADER, script_defaults, script_id
from batchline.operators import graph
from batchline.scratch import Scratch, small_broadcasts

# Kinds of edges, and the type of resources that are filled from files.
DERIVED, ORIGINATES = "DERIVED_FROM", "ORIGINATES_FROM"
FROM_FILES = "structure"

EDGE_ATTRIBUTES = ("script_name", "script_type", "update_mode", "schedule_frequency", "schedule_status")


def _labels(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("en_name").alias("target"), F.col("label"), F.col("type"))


def _from_files() -> Column:
    return F.col("label").eqNullSafe("DataResource") & F.col("type").eqNullSafe(FROM_FILES)


def label_members(tables: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Rows of ``tables`` (``table_name``) that are nodes of one label."""
    members = nodes.filter(F.col("label") == label).select(F.col("en_name").alias("table_name"))
    return tables.join(members, "table_name", "left_semi")


def enabled_by_frequency(schedules: DataFrame, frequency: str) -> DataFrame:
    """Enabled rows of a table schedule with one frequency."""
    return schedules.filter(F.col("is_enabled") & (F.col("schedule_frequency") == frequency))


def enabled_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables switched on by a model edge, a resource edge or, for file tables, their node."""
    on = edges.filter("schedule_status").select("target", "rel")
    by_edge = on.join(_labels(nodes), "target").filter(
        ((F.col("label") == "DataModel") & (F.col("rel") == DERIVED))
        | ((F.col("label") == "DataResource") & (F.col("rel") == ORIGINATES))
    )
    by_node = nodes.filter(_from_files() & F.col("schedule_status"))
    names = by_edge.select(F.col("target").alias("table_name")).union(by_node.select("en_name"))
    return names.filter("table_name <> ''").distinct()


def one_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct sources of every table, with the attributes of the edge.

    Models are followed along ``DERIVED_FROM``, resources along ``ORIGINATES_FROM``, other
    tables along any edge. Tables filled from files have no source but the file loader, with
    the schedule of their node.
    """
    wanted = (
        F.when(F.col("label") == "DataResource", F.col("rel") == ORIGINATES)
        .when(F.col("label") == "DataModel", F.col("rel") == DERIVED)
        .otherwise(True)
    )
    linked = edges.join(_labels(nodes).filter(~_from_files()), "target").filter(wanted)
    loaded = nodes.filter(_from_files()).select(
        F.col("en_name").alias("target"), "label", F.lit(None).cast("string").alias("source"),
        F.lit(FILE_LOADER).alias("script_name"), F.lit("python_script").alias("script_type"),
        F.coalesce("update_mode", F.lit("append")).alias("update_mode"),
        F.coalesce("schedule_frequency", F.lit("daily")).alias("schedule_frequency"),
        F.coalesce("schedule_status", F.lit(True)).alias("schedule_status"),
    )
    return linked.select("target", "label", "source", *EDGE_ATTRIBUTES).unionByName(loaded)


def scripts_of_edges(hops: DataFrame) -> DataFrame:
    """One row per script ``(target, script_name)`` with its first edge's attributes.

    ``hops`` is like ``one_hop``; the first edge is the one with the least source. A missing
    script name becomes the table's own. ``n_sources`` counts distinct sources.
    """
    named = _named(hops)
    first = F.min(F.struct("source", "script_type", "update_mode", "schedule_frequency", "schedule_status"))
    grouped = named.groupBy("target", "script_name", "source").agg(first.alias("first"))
    return grouped.groupBy("target", "script_name").agg(
        F.min("first").alias("first"), F.count("source").alias("n_sources")
    ).select(
        "target", "script_name", "n_sources", "first.script_type", "first.update_mode",
        "first.schedule_frequency", "first.schedule_status",
    )


def sources_of_scripts(hops: DataFrame) -> DataFrame:
    """The other half: distinct ``target, script_name, source``."""
    return _named(hops).filter("source IS NOT NULL").select("target", "script_name", "source").distinct()


def _named(hops: DataFrame) -> DataFrame:
    own = F.concat(F.col("target"), F.lit("_script.py"))
    return hops.withColumn("script_name", F.coalesce(F.nullif("script_name", F.lit("")), own))


def fallback_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables without an edge of their own kind: sources along any edge, default script.

    A table without any edge has one row with a null source.
    """
    bare = nodes.filter(~_from_files()).select(F.col("en_name").alias("target")).join(
        one_hop(nodes, edges).select("target"), "target", "left_anti"
    )
    any_edge = edges.select("target", "source").distinct()
    kinds = dict(edges.dtypes)
    blank = {c: F.lit(None).cast(kinds[c]) for c in EDGE_ATTRIBUTES}
    return script_defaults(bare.join(any_edge, "target", "left").withColumns(blank))


def table_scripts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scripts and script sources of all tables: typed edges, else the fallback."""
    hops = one_hop(nodes, edges).drop("label").unionByName(fallback_sources(nodes, edges))
    return scripts_of_edges(hops), sources_of_scripts(hops)


def passive_tables(
    scheduled: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 1
) -> DataFrame:
    """Scheduled tables plus the sources of scheduled models that are not scheduled.

    ``scheduled`` has ``table_name``. Added tables are not direct; the attributes of the
    edge that led to them (the least by target and script) override their node's.
    """
    directly = scheduled.select("table_name").distinct().join(
        nodes.withColumnRenamed("en_name", "table_name"), "table_name"
    )
    kept = ["table_name", "label", "status", "schedule_frequency", "update_mode", "schedule_status"]
    result = directly.select(
        *kept, F.lit(None).cast("string").alias("script_name"),
        F.lit(None).cast("string").alias("script_type"), F.lit(True).alias("is_direct"),
    )
    models = directly.filter("label = 'DataModel'").select("table_name")
    scratch, size = Scratch(nodes.sparkSession, "passive"), 1
    for depth in range(max_depth):
        via = edges.filter(F.col("rel") == DERIVED).join(
            models.withColumnRenamed("table_name", "target"), "target", "left_semi"
        )
        new = via.join(result.select(F.col("table_name").alias("source")), "source", "left_anti")
        first = new.groupBy(F.col("source").alias("table_name")).agg(
            F.min(F.struct("target", *EDGE_ATTRIBUTES)).alias("edge")
        )
        added = first.join(nodes.withColumnRenamed("en_name", "table_name"), "table_name").select(
            "table_name", "label", "status",
            *[
                F.coalesce(F.col(f"edge.{c}"), F.col(c)).alias(c)
                for c in ("schedule_frequency", "update_mode", "schedule_status")
            ],
            "edge.script_name", "edge.script_type", F.lit(False).alias("is_direct"),
        )
        if max_depth > 1:
            added, size = scratch.save(added, f"depth{depth + 1}")
        if not size:
            break
        models = added.filter("label = 'DataModel'").select("table_name")
        result = result.unionByName(added)
    return result


def closure_resources(enabled: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Resources with a data source of their own that enabled tables derive from, at any depth."""
    derived = graph.as_edges(edges.filter(F.col("rel") == DERIVED), "target", "source")
    found = graph.reach(derived, enabled.select(F.col("table_name").alias("node")))
    sources = nodes.filter("label = 'DataSource'").select(F.col("en_name").alias("source"))
    fed = edges.filter(F.col("rel") == ORIGINATES).join(sources, "source", "left_semi")
    resources = nodes.filter("label = 'DataResource'").select(F.col("en_name").alias("node"))
    return (
        found.join(resources, "node", "left_semi")
        .join(fed.select(F.col("target").alias("node")), "node", "left_semi")
        .select(F.col("node").alias("table_name"), F.lit("append").alias("execution_mode"))
    )


def _walk(starts: DataFrame, nodes: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """Steps from a (table, script) to those it needs: ``src, dst``."""
    if level not in ("resource", "source"):
        raise ValueError(f"unknown level: {level}")
    hops = one_hop(nodes, edges).filter("label IN ('DataModel', 'DataResource') AND script_name <> ''")
    first = hops.groupBy(F.col("target").alias("table_name")).agg(F.min("script_name").alias("script_name"))
    through = hops.join(
        first.unionByName(starts.select("table_name", "script_name")).distinct()
        .withColumnRenamed("table_name", "target"),
        ["target", "script_name"], "left_semi",
    ).filter("source IS NOT NULL")
    members = first
    if level == "source":
        ends = nodes.filter("label = 'DataSource'").select(
            F.col("en_name").alias("table_name"), F.lit(None).cast("string").alias("script_name")
        )
        members = members.unionByName(ends)
    # walk over (table, script) steps: a start may name a script that is not its table's first
    step = through.join(
        members.select(F.col("table_name").alias("source"), F.col("script_name").alias("next_script")),
        "source",
    )
    return step.select(
        _step("target", "script_name").alias("src"), _step("source", "next_script").alias("dst")
    ).distinct()


def script_chain(
    starts: DataFrame, nodes: DataFrame, edges: DataFrame, level: str = "self"
) -> DataFrame:
    """Scripts upstream of the starting scripts with their least distance.

    ``starts`` has ``table_name, script_name``. ``self`` is the starts alone; ``resource``
    stops before data sources; ``source`` ends with them (they have no script). A table
    takes part through its first named script; files end a chain at the file loader.
    """
    own = starts.select("table_name", "script_name", F.lit(0).alias("depth")).distinct()
    if level == "self":
        return own.withColumn("script_id", script_id(F.col("script_name"), F.col("table_name")))
    walk = _walk(starts, nodes, edges, level)
    seeds = starts.select(_step("table_name", "script_name").alias("node"))
    found = graph.reach(walk, seeds).join(seeds, "node", "left_anti")
    upstream = found.select(
        "node.table_name", F.nullif("node.script_name", F.lit("")).alias("script_name"), "depth"
    )
    return own.unionByName(upstream).withColumn(
        "script_id",
        F.when(F.col("script_name").isNotNull(), script_id(F.col("script_name"), F.col("table_name"))),
    )


def chain_order(starts: DataFrame, nodes: DataFrame, edges: DataFrame, level: str = "resource") -> DataFrame:
    """The scripts of a chain in an order in which they can run: ``place, step, table_name, script_name, script_id``.

    ``place`` is 0 for a script that needs none of the chain, else one more than the highest of
    those it needs, itself and scripts of its own cycle left aside; scripts of one place may run
    side by side. ``step`` numbers all scripts from 1 by place, then id: places are counted first
    and only ranks within a place are sorted. Data sources have no script and no place.
    """
    scratch = Scratch(edges.sparkSession, "order")
    with small_broadcasts(edges.sparkSession):
        chain, _ = scratch.save(script_chain(starts, nodes, edges, level).filter("script_name IS NOT NULL"), "chain")
        members = chain.select(_step("table_name", "script_name").alias("node"), "script_id").distinct()
        if level == "self":
            placed = members.withColumn("level", F.lit(0))
        else:
            walk = _walk(starts, nodes, edges, level)
            inside = walk.join(members.select(F.col("node").alias("src")), "src", "left_semi")
            inside = inside.join(members.select(F.col("node").alias("dst")), "dst", "left_semi")
            placed = members.join(graph.levels(inside, members.select("node")), "node")
        stored, _ = scratch.save(placed, "placed")
        # one row for each place
        before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        sizes = stored.groupBy("level").agg(F.count(F.lit(1)).alias("size"))
        bases = sizes.select("level", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
        rank = F.row_number().over(Window.partitionBy("level").orderBy("script_id", "node"))
        ordered, _ = scratch.save(
            stored.withColumn("rank", rank).join(bases, "level").select(
                F.col("level").alias("place"), (F.col("base") + F.col("rank")).alias("step"),
                "node.table_name", "node.script_name", "script_id",
            ),
            "ordered",
        )
    scratch.forget_all(but=(ordered,))
    return ordered


def _step(table: str, script: str) -> Column:
    # an empty script name stands for none: struct fields with nulls would not join
    return F.struct(
        F.col(table).alias("table_name"), F.coalesce(F.col(script), F.lit("")).alias("script_name")
    )


def valid_tables(
    tables: DataFrame, edges: DataFrame, direction: str = "downstream"
) -> DataFrame:
    """Drop tables whose status is false together with what hangs on them.

    ``tables`` has ``en_name, label, status``; a null status is valid. ``downstream`` drops
    the tables that depend on an invalid one, ``upstream`` those it depends on. Only model
    edges between two of the tables count.
    """
    if direction not in ("downstream", "upstream"):
        raise ValueError(f"unknown direction: {direction}")
    models = tables.filter("label = 'DataModel'").select(F.col("en_name").alias("target"))
    within = (
        edges.filter(F.col("rel") == DERIVED)
        .join(models, "target", "left_semi")
        .join(tables.select(F.col("en_name").alias("source")), "source", "left_semi")
    )
    ends = ("source", "target") if direction == "downstream" else ("target", "source")
    invalid = tables.filter("status = false").select(F.col("en_name").alias("node"))
    hit = graph.reach(graph.as_edges(within, *ends), invalid).select("node").union(invalid)
    return tables.join(hit.withColumnRenamed("node", "en_name"), "en_name", "left_anti")


def script_dependencies(
    scripts: DataFrame, script_sources: DataFrame, edges: DataFrame
) -> DataFrame:
    """``script_id, depends_on``: a script depends on every script that fills a source of its.

    ``scripts`` has ``target, script_name``; ``script_sources`` adds ``source``. A script
    without sources falls back on any edge of its table; if that leaves no dependency at
    all, every script does. Scripts without a dependency have one row with null.
    """
    scratch = Scratch(scripts.sparkSession, "dependencies")
    ids, _ = scratch.save(
        scripts.select(
            "target", "script_name", script_id(F.col("script_name"), F.col("target")).alias("script_id")
        ).distinct(),
        "ids",
    )
    producers = ids.select(F.col("target").alias("source"), F.col("script_id").alias("depends_on"))
    explicit = script_sources.select("target", "script_name", "source").distinct()
    links = edges.select("target", "source").filter("source IS NOT NULL").distinct()
    bare = ids.select("target", "script_name").join(explicit, ["target", "script_name"], "left_anti")
    needs = explicit.unionByName(bare.join(links, "target").select(*explicit.columns))

    def pairs(of: DataFrame) -> DataFrame:
        needed = of.join(ids, ["target", "script_name"]).select("script_id", "source")
        return (
            needed.join(producers, "source").filter("script_id <> depends_on")
            .select("script_id", "depends_on").distinct()
        )

    found, size = scratch.save(pairs(needs), "pairs")
    if not size:
        everything = ids.select("target", "script_name").join(links, "target")
        found, _ = scratch.save(pairs(everything.select(*explicit.columns)), "pairs")
    return ids.select("script_id").distinct().join(found, "script_id", "left")


def dependencies_within(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """``table_name, depends_on`` among a set of tables; null where there is none."""
    names = tables.select("table_name").distinct()
    inside = (
        edges.filter(F.col("rel") == DERIVED)
        .select(F.col("target").alias("table_name"), F.col("source").alias("depends_on")).distinct()
        .join(names.withColumnRenamed("table_name", "depends_on"), "depends_on", "left_semi")
    )
    return names.join(inside, "table_name", "left").select("table_name", "depends_on")


def pair_relations(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For pairs of models ``table1, table2``: is there an edge either way, and its script."""
    models = nodes.filter("label = 'DataModel'").select("en_name")
    known = (
        edges.filter(F.col("rel") == DERIVED)
        .groupBy("target", "source").agg(F.min("script_name").alias("script"))
        .join(models.withColumnRenamed("en_name", "target"), "target", "left_semi")
        .join(models.withColumnRenamed("en_name", "source"), "source", "left_semi")
    )

    def side(one: str, other: str, name: str) -> DataFrame:
        return known.select(
            F.col("target").alias(one), F.col("source").alias(other),
            F.lit(True).alias(f"{name}_exists"), F.col("script").alias(f"{name}_script"),
        )

    keys = ["table1", "table2"]
    return (
        pairs.join(side("table1", "table2", "forward"), keys, "left")
        .join(side("table2", "table1", "backward"), keys, "left")
        .fillna(False, ["forward_exists", "backward_exists"])
    )


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Tables on a cycle, and the least table of their component."""
    return graph.components(graph.as_edges(edges, "target", "source"))


def dependency_levels(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Level per table so that sources come first; edges inside a cycle are ignored."""
    found = graph.levels(
        graph.as_edges(edges, "target", "source"), tables.select(F.col("en_name").alias("node"))
    )
    return found.select(F.col("node").alias("table_name"), "level")


def ends_of(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables that depend on no other of the set (roots) or that none depends on (leaves)."""
    names = tables.select("table_name").distinct()
    inside = (
        edges.select("target", "source")
        .join(names.withColumnRenamed("table_name", "target"), "target", "left_semi")
        .join(names.withColumnRenamed("table_name", "source"), "source", "left_semi")
    )
    needing = inside.select(F.col("target").alias("table_name")).distinct().withColumn("needs", F.lit(True))
    needed = inside.select(F.col("source").alias("table_name")).distinct().withColumn("needed", F.lit(True))
    return (
        names.join(needing, "table_name", "left").join(needed, "table_name", "left")
        .select("table_name", F.col("needs").isNull().alias("is_root"), F.col("needed").isNull().alias("is_leaf"))
        .filter("is_root OR is_leaf")
    )


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key; rows without a key are dropped.

    The least row is a partial aggregate, so a key with very many rows is reduced before
    the shuffle. ``order`` must tell rows of one key apart.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("row")
    known = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return known.groupBy(key).agg(least).select(*[key if c == key else F.col(f"row.{c}") for c in df.columns])
