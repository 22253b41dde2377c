"""URL filter: listed rules, and a tree of path templates per host for the URLs without a rule.

The tree of a host grows one path segment at a time over distinct paths with their counts. At a
node, segments that make up enough of it stay as they are; the others are variable and become
wildcards of their shape (``<number>``, ``<hex>``, ``<file>``, ``<mixed>``, ``<word>``). Then
branches of the node whose statistics do not differ are merged: they are put in order, and two
neighbours belong together if tests of two proportions find no difference in the share of blocked
URLs among labelled ones nor in what comes next (a segment of which shape, or the end). A branch
without labels is only like other branches without labels. Merged branches share their subtrees.

URLs that a rule decides are the labels. A template is rejected if its purity, the smoothed share of
blocked among its labelled URLs, is high enough; its URLs without a rule are blocked, all others
allowed. A template without labels has purity one half and is never rejected.

A segment is a constant only if it has a fixed share of its node, so a node has a bounded number of
branches whatever the data. Everything is expressed with DataFrame functions. Counts are aggregated
before each shuffle and joins meet rows that are distinct on one side, which adaptive execution
splits where a host or path holds many rows. Each level is written to the shared folder.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and is allowed;
an empty path has no segments; a path that ends in ``/`` has an empty last segment; segments after
``LEVELS`` fall under one ``**``; of rules of equal length that fit the greater text wins; rows with
equal ``page_id`` count as rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchline.llm.common import discard, saved

#: What a segment needs to stay a constant: rows, and a share of its node (words; other shapes).
SUPPORT, SHARE, SHARE_OTHER = 3, 0.01, 0.25
LEVELS = 12
#: Standard errors by which proportions of like branches may differ.
LIKE = 2.58
#: Labelled URLs, half of them blocked, that smoothing adds to a template; the purity that rejects.
PRIOR, REJECT = 2, 0.9

#: Shapes by pattern, the first that fits; what is left is mixed.
SHAPES = {
    "<number>": "^[0-9]+$", "<hex>": "^(?=.*[0-9])[0-9a-fA-F-]{8,}$", "<file>": r"^.+\.[A-Za-z0-9]{1,5}$", "<word>": "^[^0-9]+$",
}
NEXT = ["end", "", *SHAPES, "<mixed>"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


def located(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of ``page_id, url``."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise(F.lit(""))
    rows = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return rows.select(
        "page_id", F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits ``host, path`` and its verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        host = F.col("host")
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def shape(segment: Column) -> Column:
    """The wildcard of a segment; an empty one is itself."""
    out = F.when(segment == "", F.lit(""))
    for name, pattern in SHAPES.items():
        out = out.when(segment.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("<mixed>"))


def _differ(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Whether two shares differ by more than chance; false where either has no rows."""
    both = (k1 + k2 + 1) / (n1 + n2 + 2)
    return (n1 > 0) & (n2 > 0) & (F.abs(k1 / n1 - k2 / n2) > LIKE * F.sqrt(both * (1 - both) * (1 / n1 + 1 / n2)))


_NODE = ["host", "template"]


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]


def _branches(counts: DataFrame) -> DataFrame:
    """``host, template, segment, name`` of constants and ``host, template, name`` of wildcards
    (segment null), each with the template that its rows move on to.

    ``counts`` has a row per node, segment and shape of what comes next.
    """
    own = counts.groupBy(*_NODE, "segment", "shape").agg(F.sum("n").alias("n"))
    nodes = own.groupBy(*_NODE).agg(F.sum("n").alias("all"))
    share = F.when(F.col("shape").isin("<word>", ""), SHARE).otherwise(SHARE_OTHER)
    constant = (F.col("n") >= SUPPORT) & (F.col("n") >= share * F.col("all"))
    constants = own.join(nodes, _NODE).filter(constant).select(*_NODE, "segment", F.lit(True).alias("constant"))
    name = F.when(F.col("constant"), F.col("segment")).otherwise(F.col("shape"))
    kept = F.when(F.col("constant"), F.col("segment"))
    profile = [F.sum(F.when(F.col("next") == kind, F.col("n")).otherwise(0)).alias(f"next{i}") for i, kind in enumerate(NEXT)]
    branches = counts.join(constants, [*_NODE, "segment"], "left").groupBy(*_NODE, kept.alias("segment"), name.alias("name")).agg(*_sums(), *profile)
    ahead = [F.col(f"next{i}") for i in range(len(NEXT))]
    most = F.greatest(*ahead)
    branches = branches.withColumns({
        "share": F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled")).otherwise(0.0),
        "leads": F.array_position(F.array(*ahead), most), "lead": most / F.col("n"),
    })
    order = Window.partitionBy(*_NODE).orderBy(F.col("labelled") > 0, "share", "leads", "lead", "name", F.col("segment").isNull())
    was = {c: F.lag(c).over(order) for c in ("n", "labelled", "blocked", *(f"next{i}" for i in range(len(NEXT))))}
    apart = (was["labelled"] > 0) != (F.col("labelled") > 0)
    apart |= _differ(F.col("blocked"), F.col("labelled"), was["blocked"], was["labelled"])
    for i in range(len(NEXT)):
        apart |= _differ(F.col(f"next{i}"), F.col("n"), was[f"next{i}"], was["n"])
    marked = branches.withColumn("new", F.when(was["n"].isNull() | apart, 1).otherwise(0))
    marked = marked.withColumn("grouped", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # as many branches as shares allow, so the list is bounded
    members = F.array_sort(F.collect_list("name").over(Window.partitionBy(*_NODE, "grouped")))
    joined = F.when(F.size(members) == 1, members[0]).otherwise(F.concat(F.lit("{"), F.array_join(members, "|"), F.lit("}")))
    return marked.select(*_NODE, "segment", "name", F.concat("template", F.lit("/"), joined).alias("moved"))


def grown(paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``paths`` (``host, path, n, labelled, blocked``, a row per path) with their ``template``."""
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("path", "^/", ""), "/"))
    state = saved(paths.withColumns({"segments": parts, "template": F.lit("")}), "paths")
    depth = state.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(1, min(depth, levels) + 1):
        segment, following = F.get("segments", F.lit(level - 1)), F.get("segments", F.lit(level))
        active = state.filter(F.size("segments") >= level).withColumns({
            "segment": segment, "shape": shape(segment), "next": F.when(following.isNull(), "end").otherwise(shape(following)),
        })
        counts = active.groupBy(*_NODE, "segment", "shape", "next").agg(*_sums())
        moves = saved(_branches(counts), "moves")
        constants = moves.filter("segment IS NOT NULL").select(*_NODE, F.col("segment").alias("at"), F.col("moved").alias("by_segment"))
        wild = moves.filter("segment IS NULL").select(*_NODE, F.col("name").alias("at"), F.col("moved").alias("by_shape"))
        here = state.withColumns({"segment": segment, "shape": F.when(segment.isNotNull(), shape(segment))})
        moved = here.join(constants.withColumnRenamed("at", "segment"), [*_NODE, "segment"], "left")
        moved = moved.join(wild.withColumnRenamed("at", "shape"), [*_NODE, "shape"], "left")
        after = saved(moved.withColumn("template", F.coalesce("by_segment", "by_shape", "template")).select(state.columns), "paths")
        discard(state, moves)
        state = after
    deeper = F.when(F.size("segments") > levels, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return state.withColumn("template", deeper).drop("segments")


def templates(paths: DataFrame, prior: int = PRIOR, reject: float = REJECT) -> DataFrame:
    """``host, template`` with rows, labels, ``purity`` and ``rejected``."""
    purity = (F.col("blocked") + prior / 2) / (F.col("labelled") + prior)
    return paths.groupBy(*_NODE).agg(*_sums()).withColumn("purity", purity).withColumn("rejected", F.col("purity") >= reject)


def report(pages: DataFrame, rules: tuple[Rule, ...] = RULES, levels: int = LEVELS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the ``template`` with its ``purity``, a row per
    row of ``page_id, url``."""
    thin = located(pages)
    text, verdict = ruled(rules)
    paths = thin.groupBy("host", "path").agg(F.count("*").alias("n")).withColumns({"rule": text, "given": verdict})
    labels = {"labelled": F.when(F.col("rule").isNotNull(), F.col("n")).otherwise(0), "blocked": F.when(F.col("given") == "block", F.col("n")).otherwise(0)}
    placed = grown(paths.withColumns(labels), levels)
    found = saved(templates(placed), "templates")
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    judged = placed.join(found.select(*_NODE, "purity", "rejected"), _NODE).select(
        "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "template", "purity"
    )
    return thin.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", "verdict", "template", "purity")
