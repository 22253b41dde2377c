"""Near-duplicate vectors: a subspace pigeonhole join.

Two unit vectors of cosine c are at squared distance 2 - 2 c. All vectors are turned by one random
rotation and split into blocks of ``WIDTH`` coordinates. If the whole squared distance is within
the budget, then in at least one block it is within the block's proportional share. So each block
is range-joined on its own, on a grid over its first coordinates whose cells are wider than the
block's radius: a vector lies in its home cell and is copied to the later cells that its radius
touches; a pair is compared in the later of its two home cells. Cells with many vectors are cut
into chunks, and each pair of chunks is one task's work.

Rotated vectors only choose candidates, with slack; the decision is the cosine of the vectors as
they came, in double precision, so that ties with the limit are decided as they fall. A pair that an
earlier block has found as well is left to that block, so each link counts once. No pairs leave the tasks: a
cell yields, for each vector, its number of links and the root of a spanning forest of them.

Equal vectors of one label are one node with a number of copies. Defined cases: vectors that are
null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing; vectors of different lengths never link; an empty table gives no rows; rows with equal
``vec_id`` count as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchline.llm.common import saved
from batchline.llm.links import components

COSINE = 0.98
WIDTH = 8
#: Coordinates of a block that the grid is laid over, and a cell's side in radii.
GRID = 3
SIDE = 4.0
CHUNK = 1000
#: Pairs that are verified at a time.
PAIRS = 40_000
#: Budgets are widened by this much, far more than rounding and far less than any distance.
SLACK = 1e-9


@cache
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix by Gram-Schmidt. Single operations and sums by row alone, so that
    every worker gets the same numbers whatever its linear algebra library."""
    a = np.random.default_rng(20 + d).normal(size=(d, d))
    for k in range(d):
        a[k] /= np.sqrt((a[k] * a[k]).sum())
        a[k + 1 :] -= (a[k + 1 :] * a[k]).sum(axis=1)[:, None] * a[k]
    return a


def rotated(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one, turned; each row's numbers depend on that row alone, so tasks that
    meet the same pair see the same distances."""
    v = raw.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # lengths that would overflow or vanish
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    turn, out = rotation(v.shape[1]), np.zeros_like(v)
    for begin in range(0, len(v), 1024):
        part, sums = v[begin : begin + 1024], out[begin : begin + 1024]
        for k, row in enumerate(turn):
            sums += part[:, k, None] * row
    return out


def blocks(d: int) -> list[tuple[int, int]]:
    return [(a, min(d, a + WIDTH)) for a in range(0, d, WIDTH)]


def radius2(d: int, b: int, cosine: float) -> float:
    first, last = blocks(d)[b]
    return (2 - 2 * cosine) * (last - first) / d + SLACK


def _double(rows: DataFrame) -> bool:
    return "double" in dict(rows.dtypes)["embedding"]


def checked(rows: DataFrame) -> DataFrame:
    """``vec_id, node, label, d, raw``: node null where nothing can link; ``raw`` is the vector as it
    came, in the table's own precision (64-bit ones scaled by a power of two, so that squares
    neither overflow nor vanish). Rotated ones are made again where they are needed."""
    double = _double(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_node, out_d, out_raw = [], [], []
            for raw, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
                v = None
                if raw and label is not None and not any(x is None for x in raw):
                    v = np.array(raw, np.float64) + 0.0
                    v = v if np.isfinite(v).all() and v.any() else None
                if v is None:
                    out_node.append(None), out_d.append(0), out_raw.append(None)
                    continue
                key = hashlib.blake2b(f"{label}|".encode() + v.tobytes(), digest_size=16).digest()
                out_raw.append(np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tobytes() if double else v.astype("<f4").tobytes())
                out_node.append(key), out_d.append(len(v))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(out_node, pa.binary()), batch.column("label"), pa.array(out_d, pa.int32()), pa.array(out_raw, pa.binary())],
                ["vec_id", "node", "label", "d", "raw"],
            )

    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, node binary, label {kinds['label']}, d int, raw binary"
    return rows.select("vec_id", "embedding", "label").mapInArrow(run, schema)


def _cells(home: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Home cells (all True) and the later cells each box touches: (which rows, cells)."""
    g = home.shape[1]
    yield np.arange(len(home)), home
    for move in np.ndindex(*(3,) * g):
        step = np.array(move) - 1
        nonzero = np.flatnonzero(step)
        if not len(nonzero) or step[nonzero[0]] < 0:
            continue  # the home itself, and cells before it
        at = home + step
        touched = ((at >= low) & (at <= high)).all(axis=1)
        yield np.flatnonzero(touched), at[touched]


def dealt(nodes: DataFrame, cosine: float, double: bool) -> DataFrame:
    """``cell, home, node`` of every node in every block, with its vector and copies."""
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("d").to_numpy()
            for d in np.unique(dims):
                some = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = rotated(np.frombuffer(b"".join(some.column("raw").to_pylist()), kind).reshape(-1, d))
                labels = some.column("label").to_pylist()
                for b, (first, last) in enumerate(blocks(int(d))):
                    y = x[:, first : min(last, first + GRID)]
                    r = np.sqrt(radius2(int(d), b, cosine))
                    side = SIDE * r
                    home, low, high = (np.floor((y + move) / side).astype(np.int64) for move in (0, -r, r))
                    for at, cells in _cells(home, low, high):
                        own = [hashlib.blake2b(f"{labels[i]}|{d}|{b}|{c.tolist()}".encode(), digest_size=8).digest() for i, c in zip(at, cells, strict=True)]
                        key = np.frombuffer(b"".join(own), np.int64) if own else np.zeros(0, np.int64)
                        rows = some.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array(np.full(len(at), b, np.int32)), pa.array((cells == home[at]).all(axis=1)), *(rows.column(c) for c in ("node", "d", "copies", "raw"))],
                            ["cell", "block", "home", "node", "d", "copies", "raw"],
                        )

    return nodes.mapInArrow(run, "cell long, block int, home boolean, node binary, d int, copies long, raw binary")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, pair by pair, so that every task rounds alike."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _pairs(x: np.ndarray, raw: np.ndarray, block: int, d: int, left: np.ndarray, right: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between rows ``left`` and ``right`` that this block is the first to find."""
    spans = blocks(d)
    first, last = spans[block]
    for begin in range(0, len(left), 512):
        part = left[begin : begin + 512]
        a, b = x[part, first:last], x[right, first:last]
        near = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T <= radius2(d, block, cosine) + 1e-6
        if same:
            near &= part[:, None] < right[None, :]
        i, j = np.nonzero(near)
        for cut in range(0, len(i), PAIRS):
            p, q = part[i[cut : cut + PAIRS]], right[j[cut : cut + PAIRS]]
            u, v = x[p], x[q]
            away = (u - v) ** 2  # pair by pair as well
            good = cosines(raw[p], raw[q]) >= cosine
            good &= away[:, first:last].sum(axis=1) <= radius2(d, block, cosine)
            for earlier in range(block):
                c, e = spans[earlier]
                good &= away[:, c:e].sum(axis=1) > radius2(d, earlier, cosine)
            yield p[good], q[good]


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least row that each row reaches over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[p], root[q])
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
        root = root[root]
        if (root == before).all():
            return root


def counted(rows: DataFrame, cosine: float, double: bool) -> DataFrame:
    """``node, links, root`` of each node that has links in a cell."""

    kind = np.float64 if double else np.float32

    def work(table: list[tuple]) -> pa.RecordBatch | None:
        if len(table) < 2:
            return None
        d, block = table[0][3], table[0][1]
        home = np.array([r[2] for r in table])
        copies = np.array([r[4] for r in table], np.int64)
        chunk = np.array([r[6] for r in table])
        raw = np.frombuffer(b"".join(r[5] for r in table), kind).reshape(-1, d)
        x = rotated(raw)
        low, high = chunk.min(), chunk.max()
        one, two = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        links, pairs = np.zeros(len(table), np.int64), []
        if low == high:
            jobs = [(one[home[one]], one[home[one]], True), (one[~home[one]], one[home[one]], False)]
        else:
            jobs = [(one[home[one]], two, False), (one[~home[one]], two[home[two]], False)]
        for left, right, same in jobs:
            if len(left) and len(right):
                for p, q in _pairs(x, raw, block, d, left, right, same, cosine):
                    links += np.bincount(p, copies[q], len(table)).astype(np.int64) + np.bincount(q, copies[p], len(table)).astype(np.int64)
                    pairs.append((p, q))
        at = np.flatnonzero(links)
        if not len(at):
            return None
        root = _forest(len(table), *(np.concatenate([x[i] for x in pairs]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays(
            [pa.array([table[i][0] for i in at], pa.binary()), pa.array(links[at]), pa.array([table[i][0] for i in root[at]], pa.binary())],
            ["node", "links", "root"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("work", "node", "block", "home", "d", "copies", "raw", "chunk")]
            for key, *row in zip(*columns, strict=True):
                if key != own:
                    if (out := work(held)) is not None:
                        yield out
                    own, held = key, []
                held.append(tuple(row))
        if (out := work(held)) is not None:
            yield out

    # only cells with a home row and another row can hold a pair
    sizes = rows.groupBy("cell").agg(F.count("*").alias("size"), F.count_if("home").alias("homes")).filter("size > 1 AND homes > 0")
    full = rows.join(sizes.drop("homes"), "cell")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    full = full.withColumns({"chunks": chunks}).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    each = full.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.xxhash64("cell", F.least("chunk", "with"), F.greatest("chunk", "with"))
    work_rows = each.select(key.alias("work"), "node", "block", "home", "d", "copies", "raw", "chunk")
    return work_rows.repartition(F.col("work")).sortWithinPartitions("work", "node").mapInArrow(run, "node binary, links long, root binary")


def report(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``."""
    all_ = saved(checked(rows), "checked", compression="none")
    able = all_.filter("node IS NOT NULL")
    nodes = able.groupBy("node").agg(
        F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("d").alias("d"), F.any_value("raw").alias("raw"),
    )
    nodes = saved(nodes, "nodes", compression="none")
    cells = saved(dealt(nodes, cosine, _double(rows)), "cells")
    found = saved(counted(cells, cosine, _double(rows)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "copies").join(links, "node", "left").join(classes, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    thin = all_.select("vec_id", "node").join(known, "node", "left")
    names = thin.filter("node IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = thin.join(names, "component", "left")
    component = F.coalesce("least", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
