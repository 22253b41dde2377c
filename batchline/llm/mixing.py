"""Mixing sources to target weights along a curriculum.

Targets. Sources in code point order (null last) have the weights 5, 2, 1, repeating, and share
the sum of all sizes (words). A target stops at ``MOST`` times its source's size and what is over
is shared by weight among the rest, until none is above.

Positions. Each source has a schedule: a relative weight at the knots of training time 0..1,
linear between them, scaled so that its integral is one. Its integral is the share of the
source's target due by a time. A source's documents stand in the order of a hash; the words
before a document are its place in the source's cumulative demand, and the inverse of the integral
turns that into a training time. A source whose target is over its size begins again: each copy
has a place of its own; the last round takes words until the target is met, cutting one document.
``in_order`` range-sorts the copies by time.

Words before a document are summed in two steps (hash ranges of a source, then inside a range), so
a source with a third of all rows is spread. All of this is done on rows without texts; copies are
then joined to their texts by place (file and row) and range-sorted. On the driver is one row per
source, as the schedule is given per source.

Defined cases: null text has size 0; a document of size 0 is taken 0 times; a null source is a
source of its own; rows with equal id and text follow one another; without any word all targets
are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchline.llm.common import BLANK, held, saved

#: Weights, taken in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weights at knots of training time, by turn: level, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
MOST = 3.0
#: Rows of a hash range, on average over sources.
RANGE = 20_000

_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Each source's words: by weight, none over ``most`` times its size."""
    out, open_, left = np.zeros(len(sizes)), sizes > 0, float(sizes.sum())
    while open_.any() and left > 0:
        level = left / weights[open_].sum()
        over = open_ & (weights * level > most * sizes)
        if not over.any():
            out[open_] = weights[open_] * level
            break
        out[over] = most * sizes[over]
        left -= float(out[over].sum())
        open_ &= ~over
    return out


@dataclass(frozen=True)
class Piece:
    """A schedule between two knots: time, integral so far, weight at either end."""

    t0: float
    t1: float
    c0: float
    w0: float
    w1: float


def integrated(knots: tuple[tuple[float, float], ...]) -> list[Piece]:
    """The schedule's integral, piece by piece, scaled to one in all."""
    area = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:], strict=False))
    pieces, sofar = [], 0.0
    for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
        pieces.append(Piece(a, b, sofar, u / area, v / area))
        sofar += (b - a) * (u + v) / 2 / area
    return pieces


def due(pieces: list[Piece], time: float) -> float:
    """Share of the target due by ``time``."""
    piece = [p for p in pieces if p.t0 <= time][-1]
    x = time - piece.t0
    return piece.c0 + piece.w0 * x + (piece.w1 - piece.w0) / (piece.t1 - piece.t0) * x * x / 2


def time_of(share: Column, pieces: list[Piece]) -> Column:
    """The inverse of ``due``."""

    def inside(p: Piece) -> Column:
        slope = (p.w1 - p.w0) / (p.t1 - p.t0)
        more = F.greatest(share - p.c0, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(p.w0 * p.w0) + 2 * slope * more, F.lit(0.0)))
        step = F.when(F.lit(p.w0) + root > 0, 2 * more / (F.lit(p.w0) + root)).otherwise(0.0)
        return F.least(F.lit(p.t0) + step, F.lit(p.t1))

    out = inside(pieces[0])
    for p in pieces[1:]:
        out = F.when(share >= p.c0, inside(p)).otherwise(out)
    return out


#: A row's place: a hash of its file's name, and its number there.
_PLACE = ["file", "row"]


def _placed(docs: DataFrame) -> DataFrame:
    """The rows of a table of files as ``doc``, with their place."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


def _thin(docs: DataFrame, *keep: Column) -> DataFrame:
    """What the assignment needs of each row, stored; no text."""
    facts = docs.select(
        *keep, F.col("doc_id").alias("id"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("hash"),
    )
    return saved(facts, "sizes")


def _assigned(thin: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``thin`` with ``source_size, target, before, rounds, last, taken, turn``."""
    spark = thin.sparkSession
    sources = thin.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()
    # by code point, null last: one row per source
    sources.sort(key=lambda r: (r["source"] is None, [ord(c) for c in str(r["source"])] if r["source"] is not None else []))
    ranges = max(1, math.ceil(sum(r["rows"] for r in sources) / RANGE))
    turns = [i % len(weights) for i in range(len(sources))]
    aims = targets(np.array([r["size"] for r in sources], float), np.array([weights[t] for t in turns], float), most)
    given = [(r["source"], int(r["size"]), float(a), t) for r, a, t in zip(sources, aims.tolist(), turns, strict=True)]
    kind = dict(thin.dtypes)["source"]
    plan = spark.createDataFrame(given, f"source {kind}, source_size long, target double, turn int")
    # ranges of the hash, in its order
    cut = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * ranges).alias("part")
    parts = thin.groupBy("source", cut).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("source", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    known = bases.join(plan, bases["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    inside = Window.partitionBy("source", "part").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = thin.withColumn("part", cut).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    own = known.withColumnsRenamed({"source": "of", "part": "of_part"})
    both = numbered.join(own, numbered["source"].eqNullSafe(own["of"]) & (numbered["part"] == own["of_part"]))
    before = F.col("base") + F.col("within")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round("target").cast("long") - F.col("rounds") * F.col("source_size")
    out = both.withColumns({"before": before, "rounds": rounds}).drop("of", "of_part", "part", "base", "within")
    out = out.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
    return out.withColumn("taken", F.col("rounds") * F.col("size") + F.col("last"))


def assigned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per row of ``docs`` (as ``doc``): ``source, size, source_size, target, before,
    rounds, last, taken, turn``.

    ``before``: words of the source before this document; ``rounds``: whole copies; ``last``: words
    of a further, cut copy (0: none). All of it is found on rows without texts.
    """
    docs = held(docs, "mixed")
    rows = _placed(docs)
    thin = _thin(docs, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(_assigned(thin, weights, most).drop("id", "hash"), _PLACE).drop(*_PLACE)


def _time(words_before: Column, words: Column, schedules) -> Column:
    share = (words_before + words / 2) / F.col("target")
    out = F.lit(None).cast("double")
    for turn, knots in enumerate(schedules):
        out = F.when(F.col("turn") == turn, time_of(share, integrated(knots))).otherwise(out)
    return out


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, schedules=SCHEDULES, most: float = MOST) -> DataFrame:
    """One row per copy that the mix takes: ``doc, copy, words, size, time``.

    Copies and times are found on rows without texts; a text is joined once.
    """
    docs = held(docs, "mixed")
    thin = _thin(docs, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = _assigned(thin, weights, most).filter("taken > 0")
    counts = F.expr("sequence(0, cast(rounds + if(last > 0, 0, -1) as int))")
    each = rows.withColumn("copy", F.explode(counts))
    words = F.when(F.col("copy") < F.col("rounds"), F.col("size")).otherwise(F.col("last"))
    each = each.withColumn("words", words)
    place = F.col("copy") * F.col("source_size") + F.col("before")
    each = saved(each.select(*_PLACE, "copy", "words", "size", _time(place, F.col("words"), schedules).alias("time")), "copies")
    return _placed(docs).join(each, _PLACE).drop(*_PLACE)


def in_order(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, schedules=SCHEDULES, most: float = MOST) -> DataFrame:
    """The mix with the columns of ``docs``, range-sorted by training time, a row per copy.

    Times spread the words over 0..1, so the ranges are cut evenly without sampling. In a cut copy
    the words that stay are joined by single spaces.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = copies(docs, weights, schedules, most)
    part = F.least(F.floor(F.col("time") * n), F.lit(n - 1)).cast("int")
    laid = each.repartitionById(n, part).sortWithinPartitions("time", "doc.doc_id", "copy")
    words = F.filter(F.split(F.col("doc.text"), BLANK), lambda w: w != "")
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(words, 1, F.col("words").cast("int")), " ")).otherwise(F.col("doc.text"))
    return laid.select(*((text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the time of the first copy, range-sorted by
    that time; documents that are not taken come last."""
    rows = _assigned(_thin(docs), WEIGHTS, MOST)
    first = F.when(F.col("taken") > 0, _time(F.col("before"), F.when(F.col("rounds") > 0, F.col("size")).otherwise(F.col("last")), SCHEDULES))
    out = rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", first.alias("first_time"))
    return out.orderBy(F.asc_nulls_last("first_time"), "doc_id")
