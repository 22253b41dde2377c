"""Distributed walks over a directed graph held as an edge table.

An edge table has ``src`` and ``dst``. Every walk works on sets of nodes, never on pairs of
nodes, so that its tables stay within nodes plus edges. Each round writes the new frontier
to the shared folder and reads it back: the plan stays short, a lost executor re-reads
files, and the size of the frontier lets Catalyst broadcast it when it is small and shuffle it
(with AQE splitting hot keys on the edge side) when it is not. Small is a megabyte in memory
(``scratch.small_broadcasts``), so what the rounds send to the driver does not grow with the graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchline.scratch import Rounds, Scratch, nothing, small_broadcasts


def _walk(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A walk over ``edges``: all its joins are done when it returns, with small broadcasts only."""

    @wraps(run)
    def bounded(edges: DataFrame, *rest, **named) -> DataFrame:
        with small_broadcasts(edges.sparkSession):
            return run(edges, *rest, **named)

    return bounded


def as_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct edges with both ends known, under the names the walks use."""
    edge = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return edge.filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


@_walk
def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes at one or more steps from any seed, with their least number of steps.

    ``seeds`` has one column ``node``. A seed is in the result only if an edge leads to it.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    edges, _ = scratch.save(edges, "edges")
    frontier, size = scratch.save(seeds.select("node").distinct(), "seeds")
    found = Rounds(scratch, "found", f"node {dict(frontier.dtypes)['node']}", "depth")
    depth = 0
    while size and (max_depth is None or depth < max_depth):
        depth += 1
        step = edges.join(frontier, edges["src"] == frontier["node"], "left_semi")
        fresh = step.select(F.col("dst").alias("node")).distinct()
        frontier, size = found.add(fresh.join(found.all(), "node", "left_anti"), depth)
    scratch.forget_all()
    return found.all()


def _trim(scratch: Scratch, edges: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Cut edges that lead nowhere or come from nowhere, which are on no cycle, as long as a pass
    cuts a hundredth of them: so the passes grow with the logarithm of the edges."""
    while size:
        into = edges.select(F.col("dst").alias("node")).distinct()
        out_of = edges.select(F.col("src").alias("node")).distinct()
        kept = edges.join(into, edges["src"] == into["node"], "left_semi")
        kept = kept.join(out_of, kept["dst"] == out_of["node"], "left_semi")
        before = edges
        edges, left = scratch.save(kept, "trimmed")
        scratch.forget(before)
        if left > 0.99 * size:
            return edges, left
        size = left
    return edges, size


_HOPS = 8


def _spread_least(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """For each node the least node that leads to it (itself included), least by hash, then by
    name: ``node, label`` with a label of ``hash, node``.

    A round takes labels one hop along the edges; from the ninth on every node then takes the
    label of its label, since what leads to that leads to it. So a label crosses a cycle or chain
    in a number of rounds that grows with the logarithm of its length.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    own = F.struct(F.xxhash64("node").alias("hash"), "node")
    labels, size = scratch.save(ends.select("node", own.alias("label"), F.lit(True).alias("changed")), "labels")
    number = 0

    def lowered(offers: DataFrame, on: Column, changed: Column) -> None:
        nonlocal labels, size
        lower = F.coalesce(F.col("offer") < F.col("label"), F.lit(False))
        merged = labels.join(offers, on, "left").select(
            "node", F.when(lower, F.col("offer")).otherwise(F.col("label")).alias("label"), (lower | changed).alias("changed")
        )
        before = labels
        labels, size = scratch.save(merged, "labels", counted="changed")
        scratch.forget(before)

    while size:
        number += 1
        changed = labels.filter("changed").select(F.col("node").alias("src"), "label")
        offered = edges.join(changed, "src").groupBy("dst").agg(F.min("label").alias("offer"))
        lowered(offered, labels["node"] == offered["dst"], F.lit(False))
        if size and number > _HOPS:
            # only of labels that have a lower one themselves
            further = labels.filter("node <> label.node").select(F.col("node").alias("by"), F.col("label").alias("offer"))
            lowered(further, labels["label.node"] == further["by"], F.col("changed"))
    return labels.select("node", "label")


@_walk
def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components that hold a cycle: ``node, component`` (its least node).

    Each round labels every node with the least node that leads to it, least by hash, and within
    one label with the least that it leads to. Where both are the same node, all of that label,
    if several, are one component. Any other component lies within one label both ways, so edges between labels
    go, as do the labels' own nodes, which are settled. Since the hash has nothing to do with the
    order along the edges, few rounds are needed whatever the length of cycles and chains.
    """
    scratch = Scratch(edges.sparkSession, "components")
    kind = dict(edges.dtypes)["src"]
    found = Rounds(scratch, "found", f"node {kind}, label struct<hash:bigint,node:{kind}>", "round")
    edges, size = scratch.save(edges, "edges")
    loops, n_loops = scratch.save(edges.filter("src = dst").toDF("node", "component"), "loops")
    if n_loops:
        edges, size = scratch.save(edges.filter("src <> dst"), "edges")
    edges, size = _trim(scratch, edges, size)
    number = 0
    while size:
        number += 1
        labels = _spread_least(scratch, edges)
        inside, size = scratch.save(_inside(edges, labels), "inside")
        if not size:
            break
        backward = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        led_to = _spread_least(scratch, backward).withColumnRenamed("label", "least")
        both, _ = scratch.save(labels.join(led_to, "node"), "both")
        found.add(both.filter("label = least").select("node", "label"), number)
        # a label's own node leads back to itself, or is on no cycle
        open_ones = both.filter("label <> least AND node <> label.node")
        groups = open_ones.select("node", F.struct("label", "least").alias("group"))
        rest, size = scratch.save(_inside(inside, groups), "rest")
        scratch.forget_all(but=(loops, rest))
        edges, size = _trim(scratch, rest, size)
    members = found.all()
    # a label's own node alone is no cycle
    least = members.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    result = members.join(least, "label").select("node", "component")
    both, _ = scratch.save(result.unionByName(loops.join(result, "node", "left_anti")), "components")
    scratch.forget_all(but=(both,))
    return both


def _inside(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between two nodes of one group; ``groups`` is ``node`` and one more column."""
    group = next(c for c in groups.columns if c != "node")
    of_src = groups.select(F.col("node").alias("src"), F.col(group).alias("src_group"))
    of_dst = groups.select(F.col("node").alias("dst"), F.col(group).alias("dst_group"))
    return (
        edges.join(of_src, "src").join(of_dst, "dst")
        .filter("src_group = dst_group").select("src", "dst")
    )


_LOG = "node {kind}, filled bigint, top int, degree bigint, level int"
_FOLD = 16


class _Peel:
    """Nodes placed one after another, each when all it needs is placed.

    A round joins the edges with the nodes placed in the round before and adds one row for every
    node that this reached: how many of its needs are placed by now, and the highest level among
    them. A node whose needs are all placed is one level above the highest. So a round is one
    write; edges are never rewritten. Rows of nodes that still wait are folded now and then.
    """

    def __init__(self, scratch: Scratch, degrees: DataFrame):
        self.scratch, self.degrees = scratch, degrees
        self.columns = _LOG.format(kind=dict(degrees.dtypes)["node"])
        self.log = Rounds(scratch, "placed", self.columns, "round")
        self.number, self.placed = 0, 0
        self.waiting, self.folded = nothing(scratch.spark, "node {}, filled bigint, top int".format(dict(degrees.dtypes)["node"])), 0

    def _add(self, rows: DataFrame) -> tuple[DataFrame, int]:
        stored, size = self.log.add(rows, self.number, counted="level IS NOT NULL")
        self.number, self.placed = self.number + 1, self.placed + size
        return stored.filter("level IS NOT NULL").select("node", "level"), size

    def _partly(self) -> DataFrame:
        """Nodes that wait for some of their needs: ``node, filled, top``."""
        recent = self.log.since(self.folded).filter("level IS NULL").select("node", "filled", "top")
        together = self.waiting.unionByName(recent).groupBy("node").agg(F.max("filled").alias("filled"), F.max("top").alias("top"))
        return together

    def run(self, edges: DataFrame, start: DataFrame) -> None:
        """Place ``start`` (rows of the log) and, as long as there is one, what that frees."""
        frontier, size = self._add(start)
        while size:
            if self.number - self.folded >= _FOLD:
                done = self.log.all().filter("level IS NOT NULL").select("node")
                self.waiting, _ = self.scratch.save(self._partly().join(done, "node", "left_anti"), "waiting")
                self.folded = self.number
            reached = edges.join(frontier, edges["dst"] == frontier["node"]).groupBy(F.col("src").alias("node")).agg(
                F.count(F.lit(1)).alias("more"), F.max("level").alias("high")
            )
            before = reached.join(self._partly(), "node", "left").join(self.degrees, "node")
            filled = F.col("more") + F.coalesce("filled", F.lit(0))
            top = F.greatest("high", F.coalesce("top", F.lit(-1)))
            frontier, size = self._add(
                before.select("node", filled.alias("filled"), top.alias("top"), "degree", F.when(filled == F.col("degree"), top + 1).alias("level"))
            )

    def result(self) -> DataFrame:
        return self.log.all().filter("level IS NOT NULL").select("node", "level")


def _rows(degrees: DataFrame, filled: Column, top: Column) -> DataFrame:
    """Rows of the log for nodes with nothing left to wait for."""
    return degrees.select("node", filled.alias("filled"), top.alias("top"), "degree", (top + 1).cast("int").alias("level"))


@_walk
def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Level of each node: 0 without ``dst``, else one more than the highest of its ``dst``.

    An edge ``src, dst`` means that ``src`` needs ``dst``. Edges inside a cycle are ignored;
    cycles are looked for only among the nodes that could not be placed without that.
    ``nodes`` has one column ``node``; nodes of edges are added to it.
    """
    scratch = Scratch(edges.sparkSession, "levels")
    edges, _ = scratch.save(edges.select("src", "dst"), "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    everything = nodes.select("node").unionByName(ends).distinct()
    needs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    degrees, n_nodes = scratch.save(everything.join(needs, "node", "left").fillna(0, ["degree"]), "degrees")
    peel = _Peel(scratch, degrees)
    peel.run(edges, _rows(degrees.filter("degree = 0"), F.lit(0).cast("long"), F.lit(-1)))
    if peel.placed < n_nodes:
        # go on with the nodes that cycles hold, without the edges inside cycles
        held, _ = scratch.save(degrees.join(peel.result(), "node", "left_anti"), "held")
        known = held.select("node")
        inner_ends = edges.join(known, edges["src"] == known["node"], "left_semi")
        waiting, _ = scratch.save(inner_ends.join(known, inner_ends["dst"] == known["node"], "left_semi"), "between")
        inner, _ = scratch.save(_inside(waiting, components(waiting)).distinct(), "inner")
        ignored = waiting.join(inner, ["src", "dst"], "left_semi").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("ignored"))
        fewer = held.join(ignored, "node", "left").select("node", (F.col("degree") - F.coalesce("ignored", F.lit(0))).alias("degree"))
        peel.degrees, _ = scratch.save(fewer, "degrees")
        partly = peel.degrees.join(peel._partly(), "node", "left").fillna(0, ["filled"]).fillna(-1, ["top"])
        free = partly.filter("filled = degree")
        rest, _ = scratch.save(waiting.join(inner, ["src", "dst"], "left_anti"), "rest")
        peel.run(rest, _rows(free, F.col("filled"), F.col("top")))
    scratch.forget_all()
    return peel.result()
