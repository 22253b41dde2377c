"""Centroid clustering with an n-simplex projection in front of exact integers.

Vectors become integers, ``floor(scale * x)``, and stay integers. Several pivots span a simplex.
The distances of a vector to the pivots are taken once and kept as the coordinates of an apex over
that simplex: the place in its base and the height above it. Two apexes bound the distance of what
they stand for: it is at least their own distance, and at most that with one of them below the base.
In each round centroids get apexes too; one whose lower bound is above the least upper bound of a
vector cannot be nearest to it. The centroids that are left are compared by exact integer distances.

Every round is one pass over the stored integers that yields, for each cluster, a count and
componentwise sums, added up before the shuffle; centroids are all that reaches the driver.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are
not in the result; equal distances go to the lower centroid; with fewer vectors than centroids there
are fewer centroids; an empty table gives no rows; rows with equal ``vec_id`` count as rows, those
of them that start as centroids are ordered by components. A null ``vec_id`` comes after all others.
Integers stay exact as long as distances fit in 63 bits; components beyond 2^45 are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchline.llm.common import saved, segments

WIDTH = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SALT = 3
#: Pivots are chosen among this many vectors, the first by hash: each the one that is highest
#: above the simplex of those before.
SAMPLE, PIVOTS = 64, 12
#: Components up to which squared distances are computed in 64-bit integers.
SMALL = 1 << 27
LARGE = 1 << 45
#: Pairs of a vector and a centroid that are compared at a time.
PAIRS = 20_000


def hashed(salt: int) -> Column:
    """Lowercase hex sha256 of ``salt:vec_id``; a null id sorts after all."""
    return F.coalesce(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256), F.lit("~"))


def whole(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector`` of the vectors that count, as little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat = lists.flatten()
            values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # null components become nan
            ends = segments(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64))
            right = np.flatnonzero(np.diff(ends) == width)
            if not len(right):
                continue
            x = values[ends[right][:, None] + np.arange(width)]
            finite = np.isfinite(x).all(axis=1)
            right, x = right[finite], np.floor(x[finite] * scale)
            if len(x) and np.abs(x).max() > LARGE:
                raise ValueError("a component is too large for exact 64-bit distances")
            ints = x.astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(right)), pa.array([row.tobytes() for row in ints], pa.binary())], ["vec_id", "vector"]
            )

    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, vector binary")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``, pair by pair."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) > SMALL:
        away = x.astype(object) - c.astype(object)
        total = (away * away).sum(axis=1)
        if len(total) and max(total) >= 1 << 63:
            raise ValueError("a squared distance does not fit in 63 bits")
        return total.astype(np.int64)
    away = x - c
    return np.einsum("ij,ij->i", away, away)


@dataclass
class Simplex:
    """Pivots and the factor that turns products with the first pivot as origin into coordinates."""

    pivots: np.ndarray
    factor: np.ndarray

    def apex(self, x: np.ndarray) -> np.ndarray:
        """Coordinates over the base, and the height, from distances to the pivots alone."""
        to = np.stack([squared(x, np.broadcast_to(p, x.shape)) for p in self.pivots], axis=1).astype(np.float64)
        between = np.einsum("ij,ij->i", *[(self.pivots[1:] - self.pivots[0]).astype(np.float64)] * 2)
        products = (to[:, :1] + between[None, :] - to[:, 1:]) / 2
        base = np.linalg.solve(self.factor, products.T).T if len(between) else products
        height = np.sqrt(np.maximum(to[:, 0] - (base * base).sum(axis=1), 0))
        return np.column_stack([base, height])


def simplex(sample: np.ndarray, most: int = PIVOTS) -> Simplex:
    """Pivots out of ``sample``, each the highest above the simplex so far."""
    chosen = [0]
    x = (sample - sample[0]).astype(np.float64)
    rest = x.copy()
    scale = (x * x).sum(axis=1).max(initial=0)
    while len(chosen) < most:
        heights = (rest * rest).sum(axis=1)
        top = int(heights.argmax())
        if heights[top] <= 1e-4 * scale or not scale:
            break
        chosen.append(top)
        unit = rest[top] / np.sqrt(heights[top])
        rest = rest - np.outer(rest @ unit, unit)
    edges = x[chosen[1:]]
    return Simplex(sample[chosen], np.linalg.cholesky(edges @ edges.T) if len(edges) else np.zeros((0, 0)))


def candidates(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest, by the bounds of their apexes; never none."""
    gap = apexes[:, None, :-1] - centroids[None, :, :-1]
    base = np.einsum("ijk,ijk->ij", gap, gap)
    up, down = apexes[:, -1][:, None], centroids[:, -1][None, :]
    lower, upper = base + (up - down) ** 2, base + (up + down) ** 2
    # far more than rounding; bounds that are nearly equal leave the decision to the integers
    slack = 1e-6 * ((apexes * apexes).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :]) + 1e-3
    return lower - slack <= (upper + slack).min(axis=1)[:, None]


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray, known: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Number of the nearest centroid of each row and, if ``known``, the exact squared distance."""
    can = candidates(apexes, tops)
    cluster = can.argmax(axis=1)
    distance = np.zeros(len(x), np.int64)
    open_ = np.arange(len(x)) if known else np.flatnonzero(can.sum(axis=1) > 1)
    i, c = np.nonzero(can[open_])
    i = open_[i]
    exact = np.empty(len(i), np.int64)
    for cut in range(0, len(i), PAIRS):
        part = slice(cut, cut + PAIRS)
        exact[part] = squared(x[i[part]], centroids[c[part]])
    order = np.lexsort((c, exact, i))
    first = order[np.unique(i[order], return_index=True)[1]]
    cluster[i[first]], distance[i[first]] = c[first], exact[first]
    return cluster, distance if known else None


def _unpack(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _projected(vectors: DataFrame, shape: Simplex, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apexes = shape.apex(_unpack(batch.column("vector"), "<i8", width))
                yield batch.append_column("apex", pa.array([a.astype("<f8").tobytes() for a in apexes], pa.binary()))

    return vectors.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in vectors.schema)}, apex binary")


def _moved(stored: DataFrame, shape: Simplex, centroids: np.ndarray) -> np.ndarray:
    """One round: assign every vector, then the floored means; empty clusters stay."""
    width, tops = centroids.shape[1], shape.apex(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, object)  # a task's sums have no bound
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpack(batch.column("vector"), "<i8", width)
            cluster, _ = nearest(x, _unpack(batch.column("apex"), "<f8", len(tops[0])), centroids, tops)
            for c in np.unique(cluster):
                own = x[cluster == c]
                counts[c] += len(own)
                sums[c] += own.sum(axis=0)  # 2^45 times the rows of a batch fits
        at = np.repeat(np.flatnonzero(counts), width)
        part = np.tile(np.arange(width), len(at) // width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(counts[at]), pa.array([str(s) for s in sums[at, part]], pa.string())],
            ["cluster", "part", "n", "total"],
        )

    parts = stored.select("vector", "apex").mapInArrow(run, "cluster int, part int, n long, total string")
    sums = parts.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    after = centroids.copy()
    for cluster, part, n, total in sums.collect():  # a row per centroid and component
        after[cluster, part] = int(total) // n
    return after


def clustered(
    rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: int = SALT, width: int = WIDTH, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (exact, squared) of the vectors of ``vec_id, embedding`` that
    count, and the centroids that they are assigned to.

    The first centroids are the vectors with the least hashes, in their order.
    """
    vectors = saved(whole(rows, width, scale), "integers")
    first = vectors.orderBy(hashed(salt), "vector").limit(max(centroids, SAMPLE)).select("vector").collect()
    if not first:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, width), np.int64)
    sample = np.frombuffer(b"".join(bytes(r["vector"]) for r in first), "<i8").reshape(-1, width)
    shape = simplex(sample[:SAMPLE])
    stored = saved(_projected(vectors, shape, width), "apexes")
    places = np.array(sample[:centroids])
    for _ in range(rounds):
        before, places = places, _moved(stored, shape, places)
        if (before == places).all():
            break  # every later round would repeat this one
    tops = shape.apex(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column("vector"), "<i8", width)
                cluster, distance = nearest(x, _unpack(batch.column("apex"), "<f8", len(tops[0])), places, tops, known=True)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = dict(rows.dtypes)["vec_id"]
    return stored.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), places


def report(rows: DataFrame, **options: int) -> DataFrame:
    """The clusters with their inertia and a digest of their centroid."""
    assigned, places = clustered(rows, **options)
    spark = rows.sparkSession
    assigned = saved(assigned, "clusters")
    # at most a row per centroid from here on
    own = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    every = own.agg(F.sum("own").alias("every"))
    digests = [(i, hashlib.sha256(",".join(map(str, place.tolist())).encode()).hexdigest()) for i, place in enumerate(places)]
    names = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    facts = own.join(names, "cluster").crossJoin(every)  # one row on the right
    return assigned.join(facts, "cluster").select(
        "vec_id", "cluster", "distance", F.col("own").cast("long").alias("cluster_inertia"), F.col("every").cast("long").alias("inertia"), "centroid_sha256"
    )


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: int = SALT, width: int = WIDTH, scale: int = SCALE) -> str:
    """The rows of ``report`` as SQL: every round compares every vector with every centroid."""
    step = """,
        a{i} AS (SELECT vec_id, v, arg_min(c, (dist, c)) AS cluster, min(dist) AS distance FROM (
            SELECT k.vec_id, k.r, k.v, c{i}.c, list_sum([(k.v[i] - c{i}.v[i]) * (k.v[i] - c{i}.v[i]) for i in range(1, {width} + 1)])::BIGINT AS dist
            FROM kept k, c{i}) GROUP BY r, vec_id, v)"""
    move = """,
        m{i} AS (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (
            SELECT cluster, unnest(v) AS x, unnest(range({width})) AS place FROM a{i}) GROUP BY cluster, place),
        c{j} AS (SELECT c, coalesce((SELECT list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) FROM m{i} WHERE m{i}.cluster = c{i}.c), v) AS v FROM c{i})"""
    text = f"""
        WITH kept AS (
            SELECT row_number() OVER () AS r, vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
            WHERE len(embedding) = {width} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)))::INTEGER - 1 AS c, v FROM kept ORDER BY c LIMIT {centroids})"""
    for i in range(rounds):
        text += step.format(i=i, width=width) + move.format(i=i, j=i + 1, width=width)
    text += step.format(i=rounds, width=width)
    return text + f"""
        SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
            (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON cluster = c{rounds}.c"""
