"""Packing token sequences: a configuration linear program over the histogram of lengths.

Pieces of at most ``capacity`` tokens are counted by length (at most ``capacity`` rows, whatever
the corpus). A configuration is a multiset of lengths that fits one sequence. Its linear program
(as few configurations as cover every length) is solved by multiplicative weights: every length
has a weight that falls as it is covered; a knapsack table over the capacity, filled by dynamic
programming, prices the best configuration for each of the longest lengths that are left; the
configurations enter with a step of the scarcest length in them, rounded down to whole sequences.
Best fit completes what the program has covered, where that takes fewest sequences. Only the
histogram and the configurations are on the driver. On the executors each piece gets its rank
among pieces of its length (counted per hash bucket, so that a length that a third of all pieces
have is spread) and looks its sequence up by (length, rank).

Defined cases: null text counts as empty; a document always has its end id, so an empty text is
a piece of one token; an empty table gives no rows; repeated rows are packed as often as they
come; equal lengths are ordered by hash, then document and piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchline.llm.common import saved, segments
from batchline.llm.tokens import END, Encoder, default_path, over_texts

CAPACITY = 4096
#: Rows of a hash bucket in which pieces of one length are ranked together, on average.
RANKED = 50_000

Configuration = tuple[tuple[int, int], ...]  # (length, how many), longest first


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of the documents' ids: ``doc_id, piece, start, length, ids_crc32``."""

    def work(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, edges = encoder.encode(batch.column("text"), END)
        lengths = np.diff(edges)
        pieces = -(-lengths // capacity)
        row = np.repeat(np.arange(len(lengths)), pieces)
        piece = np.arange(len(row)) - np.repeat(segments(pieces)[:-1], pieces)
        start = piece * capacity
        length = np.minimum(capacity, lengths[row] - start)
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        at = 4 * (edges[row] + start)
        crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist(), strict=True)]
        doc = batch.column("doc_id").take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(over_texts(path or default_path(), work), schema)


# --- the program over the histogram, on the driver --------------------------------------------


def knapsack(value: np.ndarray) -> np.ndarray:
    """For every room 0..capacity the best total value of lengths that fit; ``value[n]`` is the
    worth of length n."""
    best = np.zeros(len(value))
    for room in range(1, len(value)):
        best[room] = max(best[room - 1], (best[room - 1 :: -1] + value[1 : room + 1]).max())
    return best


def best_fit(counts: np.ndarray) -> dict[Configuration, int]:
    """Each piece, longest first, into the fullest sequence that still takes it.

    Sequences that hold the same are placed into together, so the work does not grow with the
    number of pieces.
    """
    capacity = len(counts) - 1
    groups: list[list[tuple[Configuration, int]]] = [[] for _ in range(capacity + 1)]  # by room left
    waiting = np.zeros(capacity + 1, bool)

    def put(contents: Configuration, many: int, room: int) -> None:
        if many:
            groups[room].append((contents, many))
            waiting[room] = True

    for n in np.flatnonzero(counts)[::-1].tolist():
        left, waiting[0] = int(counts[n]), False
        while left:
            room = n + int(waiting[n:].argmax())
            if not waiting[room]:  # no sequence takes it: begin new ones
                room, contents, many = capacity, (), left
            else:
                contents, many = groups[room].pop()
                waiting[room] = bool(groups[room])
            each = room // n
            full = min(many, left // each)
            left -= full * each
            put((*contents, (n, each)), full, room - n * each)
            if full < many and left:  # fewer pieces than one more sequence takes
                put((*contents, (n, left)), 1, room - n * left)
                full, left = full + 1, 0
            if contents:
                put(contents, many - full, room)
    chosen: Counter[Configuration] = Counter()
    for group in groups:
        for contents, many in group:
            chosen[contents] += many
    return dict(chosen)


def _configuration(first: int, value: np.ndarray, best: np.ndarray, left: np.ndarray, present: np.ndarray) -> dict[int, int]:
    """``first`` and beside it, one after another, the piece of which the table promises most
    among lengths that are not used up."""
    room, used = len(best) - 1 - first, {first: 1}
    while room > 0:
        fit = present[: np.searchsorted(present, room, side="right")]
        worth = value[fit] + best[room - fit]
        while len(fit):
            at = int(worth.argmax())
            n = int(fit[at])
            if worth[at] < 0 or used.get(n, 0) < left[n]:
                break
            worth[at] = -1
        if not len(fit) or worth[at] < 0:
            break
        used[n] = used.get(n, 0) + 1
        room -= n
    return used


@dataclass
class Priced:
    """What one pricing added: configurations with their weights, the pieces that are then left
    uncovered, and the bound below which no packing gets."""

    weights: list[tuple[Configuration, int]]
    left: np.ndarray
    bound: float


def solve(counts: np.ndarray, rate: float = 0.05, seeds: int = 64, slack: float = 0.001) -> Iterator[Priced]:
    """Multiplicative weights for the program ``counts`` (index: length), pricing by pricing.

    A length is worth its share of a sequence times a weight that falls by ``exp(-rate * share
    covered)``. A table of these prices serves the ``seeds`` longest lengths that are left, as long
    as a configuration comes within ``slack`` sequences of what the table promises.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    bound = float(counts @ np.arange(capacity + 1)) / capacity
    while left.any():
        present = np.flatnonzero(left)
        value = np.zeros(capacity + 1)
        value[present] = present / capacity * np.exp(-rate * (1 - left[present] / counts[present]))
        best = knapsack(value)
        bound = max(bound, float(counts @ value) / best[capacity])
        weights: list[tuple[Configuration, int]] = []
        for first in present[::-1][:seeds].tolist():
            while left[first]:
                used = _configuration(first, value, best, left, present)
                worth = sum(value[n] * k for n, k in used.items())
                if weights and worth < value[first] + best[capacity - first] - slack:
                    break  # lengths that it counts on are used up: price again
                # a step that the scarcest length bears, rounded down to whole sequences
                step = min(int(left[n]) // k for n, k in used.items())
                weights.append((tuple(sorted(used.items(), reverse=True)), step))
                for n, k in used.items():
                    left[n] -= k * step
        yield Priced(weights, left.copy(), bound)


def configurations(counts: np.ndarray, pricings: int = 400, every: int = 8) -> tuple[dict[Configuration, int], float]:
    """Whole configurations that hold every piece once, and the program's lower bound.

    What the program has covered after every ``every`` pricings is completed best fit, and the
    completion with the fewest sequences stays, so that it never takes more than best fit alone.
    It ends when all is covered, at the bound, or after ``pricings`` (a bound on the driver's work).
    """
    counts = counts.astype(np.int64)
    steps: list[tuple[Configuration, int]] = []
    kept, rest = 0, best_fit(counts)  # steps that stay, and what completes them
    fewest, bound = sum(rest.values()), 0.0
    for number, priced in enumerate(solve(counts), 1):
        steps += priced.weights
        bound = priced.bound
        if number % every and number < pricings and priced.left.any():
            continue
        completion = best_fit(priced.left)
        total = sum(many for _, many in steps) + sum(completion.values())
        if total <= fewest:
            kept, rest, fewest = len(steps), completion, total
        if number >= pricings or fewest < bound + 1:
            break
    chosen = Counter(rest)
    for used, many in steps[:kept]:
        chosen[used] += many
    return dict(chosen), bound


def layout(chosen: dict[Configuration, int]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of ranks, sorted by (length, first rank)."""
    rows, sequences, ranks = [], 0, Counter()
    for used, copies in sorted(chosen.items(), reverse=True):
        offset = 0
        for n, k in used:
            rows.append((n, ranks[n], k, sequences, offset))
            ranks[n] += k * copies
            offset += n * k
        sequences += copies
    rows.sort()
    names = ("length", "rank", "each", "sequence", "offset")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}


# --- on the executors ---------------------------------------------------------------------------


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Add ``rank``: 0, 1, .. among the pieces of a length, without bringing one length
    together: counted by hash bucket first."""
    buckets = max(1, -(-rows // RANKED))
    key = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets))
    dealt = pieces.withColumn("bucket", key)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # at most one row for each length and bucket
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("within", F.row_number().over(inside) - 1)
    joined = numbered.join(bases, ["length", "bucket"])
    return joined.withColumn("rank", F.col("base") + F.col("within")).drop("base", "within", "bucket")


def placed(numbered: DataFrame, runs: dict[str, np.ndarray]) -> DataFrame:
    """Add ``sequence_id, offset`` by looking (length, rank) up in the runs."""
    far = np.int64(1) << 40

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs["length"] * far + runs["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * far + rank, side="right") - 1
            copy, place = np.divmod(rank - runs["rank"][at], runs["each"][at])
            columns = [*batch.columns[:-1], pa.array(runs["sequence"][at] + copy), pa.array(runs["offset"][at] + place * length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    names = [c for c in numbered.columns if c != "rank"]
    kinds = dict(numbered.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "sequence_id long", "offset long"])
    return numbered.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(look_up, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every document (``doc_id, text``) in sequences of at most ``capacity`` tokens.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.
    """
    pieces = saved(cut(docs, capacity, path), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    chosen, _ = configurations(counts)
    return placed(ranked(pieces, int(counts.sum())), layout(chosen)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
