"""Periodic runs of words, found on a grammar of the text.

The words of a document become ids, and Re-Pair replaces the most frequent pair of neighbours by a
new symbol until no pair occurs twice. A round replaces every pair that no occurrence of a more
frequent pair touches; equal frequencies are ordered by a hash. Each replacement notes where it
happened, so all positions that a nonterminal derives are known when the grammar is.

A run has a lowest symbol that derives all of it and so crosses the boundary of that symbol's
two halves, or a boundary of the start rule. Each boundary is looked at once, at the first place of
its nonterminal and within what that derives; what is found goes to all its other places. Parts of
one run that several symbols found lie within the whole run and merge with it.

Runs across a boundary ``m``: let ``L`` be the power of two with ``q <= L < 2q``. A run of at least
four periods ``q`` around ``m`` holds the ``L`` words before or after ``m`` and their nearest equal
on one side, which lies exactly ``q`` away. So the nearest equals of those two blocks name all
periods, and names of the blocks of 1, 2, 4, .. words (kept as long as any block occurs twice in a
document) give the length of a run in a number of steps that is logarithmic in it. A period that is
a multiple of a smaller one gives the same interval; the smallest stays.

All documents of a batch are worked on at once, with ids that no two documents share. Defined
cases: null, empty and blank texts have no words and no runs; a document is one row whatever its
length; rows with equal ``doc_id`` are rows of their own; an empty table gives no rows. ``doc_id``
may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchline.llm.common import BLANK, by_bytes, mixed, segments, spread

#: A run has at least this many words and this many periods.
LEAST, PERIODS = 6, 4
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
BYTES = 2 << 20

RUN = "struct<start:long,length:long,period:long>"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) and where each text's begin and end."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten()
    real = pc.not_equal(words, "")  # a blank at either end leaves an empty word
    solid = np.asarray(real.to_numpy(zero_copy_only=False), bool)
    return words.filter(real), segments(solid)[segments(counts)]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``keys`` (equal ones by place), where each distinct one begins in it, ranks."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), rank


@dataclass
class Grammar:
    """Every replacement: its nonterminal, where what it derives begins, is halved and ends; and
    the boundaries between symbols of the start rules."""

    rule: np.ndarray
    begin: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    top: np.ndarray


def repair(ids: np.ndarray, edges: np.ndarray) -> Grammar:
    """Re-Pair of all documents, whose ids differ; ``edges`` are where documents begin and end."""
    n = len(ids)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    symbol, begin, after = ids.astype(np.int64), np.arange(n), np.arange(1, n + 1)
    fresh = int(symbol.max(initial=-1)) + 1
    found = [(np.zeros(0, np.int64),) * 4]
    live = np.flatnonzero(~edge[after])  # left symbols of pairs that may occur twice
    while len(live):
        order, starts, rank = _ranked(symbol[live] * fresh + symbol[live + 1])
        counts = np.diff(np.append(starts, len(live)))
        first = begin[live[order[starts]]]
        often = counts[rank] >= 2
        live, rank = live[often], rank[often]
        weight = np.empty(len(counts), np.int64)
        weight[np.lexsort((first, mixed(first.astype(np.uint64)), counts))] = np.arange(len(counts))
        own = weight[rank]
        beside = np.diff(live) == 1
        hindered = np.zeros(len(live), bool)
        hindered[1:] |= beside & (own[:-1] > own[1:])
        hindered[:-1] |= beside & (own[1:] > own[:-1])
        free = np.bincount(rank, hindered, len(counts)) == 0
        # a row of one pair overlaps with itself: every other one is replaced
        at = np.arange(len(live))
        again = np.zeros(len(live), bool)
        again[1:] = beside & (rank[1:] == rank[:-1])
        row = np.maximum.accumulate(np.where(again, 0, at)) if len(live) else at
        chosen = free[rank] & ((at - row) % 2 == 0)
        taken = live[chosen]
        kinds, rule = np.unique(rank[chosen], return_inverse=True)
        found.append((rule + fresh, begin[taken], begin[taken + 1], after[taken + 1]))
        active = np.zeros(len(symbol), bool)
        active[live] = True
        symbol[taken], after[taken] = rule + fresh, after[taken + 1]
        keep = np.ones(len(symbol), bool)
        keep[taken + 1] = False
        symbol, begin, after, active = symbol[keep], begin[keep], after[keep], active[keep]
        new = symbol >= fresh
        active |= new
        active[:-1] |= new[1:]
        fresh += len(kinds)
        live = np.flatnonzero(active & ~edge[after])
    return Grammar(*(np.concatenate([f[i] for f in found]) for i in range(4)), begin[~edge[begin]])


def _around(names: np.ndarray, live: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each block to the nearest equal one before and after it; 0 where there is none."""
    places = live[order]
    equal = names[places[1:]] == names[places[:-1]]
    back, ahead = np.zeros(n, np.int32), np.zeros(n, np.int32)
    gap = (places[1:] - places[:-1])[equal]
    back[places[1:][equal]] = gap
    ahead[places[:-1][equal]] = gap
    return back, ahead


class Blocks:
    """Names of the blocks of 1, 2, 4, .. words that occur twice in a document; other blocks have
    names of their own."""

    def __init__(self, ids: np.ndarray, edges: np.ndarray):
        n = len(ids)
        self.levels: list[np.ndarray] = []
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        owner = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
        live, keys, size = np.arange(n), ids.astype(np.int64), 1
        while len(live):
            order, starts, rank = _ranked(keys)
            often = (np.diff(np.append(starts, len(keys))) >= 2)[rank]
            if not often.any():
                break
            names = -1 - np.arange(n, dtype=np.int32)
            names[live[often]] = rank[often]
            self.levels.append(names)
            self.near.append(_around(names, live, order, n))
            live = live[often]
            live = live[live + size < n]
            live = live[(owner[live + size] == owner[live]) & (names[live + size] >= 0)]
            keys = names[live].astype(np.int64) * n + names[live + size]
            size *= 2

    def periods(self, middle: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places ``p`` and periods ``q`` near the boundaries, with their numbers: the blocks at
        ``p`` and ``p + q`` are equal and lie between ``low`` and ``high``."""
        out = [(np.zeros(0, np.int64),) * 3]
        for level, (back, ahead) in enumerate(self.near):
            size = 1 << level
            for block in (middle, middle - size):
                inside = np.flatnonzero((block >= low) & (block + size <= high))
                for gaps, sign in ((back, -1), (ahead, 1)):
                    gap = gaps[block[inside]]
                    good = (2 * gap > size) & (gap <= size)
                    which, q = inside[good], gap[good].astype(np.int64)
                    p = block[which] - (q if sign < 0 else 0)
                    fits = (p >= low[which]) & (p + q + size <= high[which])
                    out.append((p[fits], q[fits], which[fits]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def extended(self, p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the stretch of period ``q`` through ``p``, within the limits."""
        right, left = p + q, p.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], 1 << level
            at = np.flatnonzero(right + size <= high)
            at = at[names[right[at]] == names[right[at] - q[at]]]
            right[at] += size
            at = np.flatnonzero(left - size >= low)
            at = at[names[left[at] - size] == names[left[at] - size + q[at]]]
            left[at] -= size
        return left, right


def find_runs(ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of every run, by begin and period, over all documents."""
    grammar, blocks = repair(ids, edges), Blocks(ids, edges)
    rules, at = np.unique(grammar.rule, return_index=True)
    owner = np.searchsorted(edges, grammar.top, side="right") - 1
    middle = np.concatenate([grammar.middle[at], grammar.top])
    low = np.concatenate([grammar.begin[at], edges[owner]])
    high = np.concatenate([grammar.end[at], edges[owner + 1]])
    p, q, which = blocks.periods(middle, low, high)
    begin, end = blocks.extended(p, q, low[which], high[which])
    long = end - begin >= np.maximum(LEAST, PERIODS * q)
    begin, end, q, which = begin[long], end[long], q[long], which[long]
    # what a nonterminal holds goes to every place that it derives
    inner = which < len(rules)
    order = np.argsort(which[inner], kind="stable")
    b, e, period, rule = begin[inner][order], end[inner][order], q[inner][order], which[inner][order]
    holders, first, held = np.unique(rule, return_index=True, return_counts=True)
    number = np.searchsorted(rules, grammar.rule)
    uses = np.flatnonzero(np.isin(number, holders))
    kind = np.searchsorted(holders, number[uses])
    each = spread(first[kind], held[kind])
    move = np.repeat(grammar.begin[uses], held[kind]) - low[rule[each]]
    begin = np.concatenate([begin[~inner], b[each] + move])
    end = np.concatenate([end[~inner], e[each] + move])
    q = np.concatenate([q[~inner], period[each]])
    return _maximal(begin, end, q, len(ids))


def _maximal(begin: np.ndarray, end: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge stretches of one period that share a period; of equal intervals the least period stays."""
    if not len(q):
        return begin, end, q
    order = np.lexsort((begin, q))
    begin, end, q = begin[order], end[order], q[order]
    shift = (np.cumsum(np.append(0, np.diff(q) != 0))) * (2 * n + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(q), bool)
    new[1:] = begin[1:] + shift[1:] > reach[:-1] - q[1:]
    starts = np.flatnonzero(new)
    lasts = np.append(starts[1:], len(q)) - 1
    begin, end, q = begin[starts], (reach - shift)[lasts], q[starts]
    order = np.lexsort((q, end, begin))
    begin, end, q = begin[order], end[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, q = begin[new], end[new], q[new]
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def _worked(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, edges = split_words(batch.column("text"))
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    ids = _ranked(owner * max(len(coded.dictionary), 1) + code)[2]
    begin, end, q = find_runs(ids, edges)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, begin + q, 1)
    np.add.at(cover, end, -1)
    kept = np.cumsum(cover[:-1]) == 0
    left = pa.LargeListArray.from_arrays(pa.array(segments(kept)[edges]), words.filter(pa.array(kept)))
    text = np.searchsorted(edges, begin, side="right") - 1
    counts = np.bincount(text, minlength=batch.num_rows)
    run = pa.StructArray.from_arrays([pa.array(begin - edges[text]), pa.array(end - begin), pa.array(q)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(segments(counts).astype(np.int32)), run),
            pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string()),
        ],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``doc_id, text``: the runs by start,
    then period, and the text without the repetitions (each run's words after its first period),
    its words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", BYTES):
                yield _worked(part)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, period`` of every run, in words from 0."""
    return periodic_runs(docs).select("doc_id", F.inline("runs"))


def with_periods(key: Column, text: Column) -> Column:
    """Texts of one in ten keys, made periodic from a word on that the key chooses; other texts
    unchanged. ``h = crc32(key)``, ``g = h div 10``; where ``h mod 10 = 0`` and there are ``n > 0``
    words, word ``i >= a`` becomes word ``a + (i - a) mod p``."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    root = F.slice(words, a + 1, F.least(p, n - a))
    again = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """A row per document: its number of runs, the longest one and digests of runs and text."""
    found = periodic_runs(docs.select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), line.alias("lines"), "collapsed")
    length = -F.col("best.length")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
