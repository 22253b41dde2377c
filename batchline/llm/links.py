"""Connected components of a large graph, as alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchline.llm.common import discard, saved


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (``a, b``, any orderable type) to ``node, component``: the least node reachable.
    Nodes without an edge to another are not in the result.

    Every round ties all neighbours of a node to the least of them (first the greater ones, then
    the lesser ones), until only stars are left. Minima are aggregated before the shuffle, and the
    join back is one that adaptive execution splits where a node has very many neighbours. Each
    round is written to the shared folder.
    """
    known = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = saved(known.filter("a <> b").distinct(), "edges")
    mark, before = _mark(stars), None
    while mark != before and mark[0]:
        before = mark
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        greater = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(greater, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        discard(stars)
        lesser = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = saved(lesser.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        mark = _mark(stars)
        discard(large)
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
