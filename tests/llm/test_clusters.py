"""Clusters against every centroid compared with every vector."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from batchline.llm import clusters
from tests.compare import duckdb_rows, spark_rows

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, n long, apex double"


def brute(rows, k=8, rounds=10, width=64, scale=1024):
    kept = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), b"".join(int(x).to_bytes(8, "little", signed=True) for x in r[1])))
    centres = [v for _, v in kept[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            members = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    own = assign()
    out = []
    for (i, _), (d, c) in zip(kept, own, strict=True):
        digest = hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
        out.append((i, c, d, sum(x for x, y in own if y == c), sum(x for x, _ in own), digest))
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 5, 0.5) for i, v in rows], SCHEMA).repartition(3)
    got = [tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in clusters.report(frame, **options).collect()]
    want = brute(rows, **{"k" if a == "centroids" else a: b for a, b in options.items()})
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_that_count(spark):
    rnd = np.random.default_rng(3)
    good = [(i, rnd.normal(size=64)) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] * 64)]
    repeated = [(5, rnd.normal(size=64)), (5, good[5][1]), (None, rnd.normal(size=64)), (107, [0.0] * 64), (108, [0.0] * 64)]
    check(spark, good + bad + repeated)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    check(spark, [(i, [float(i % 2)] * 64) for i in range(n)])


def test_ties_and_large_integers(spark):
    """Lattice points tie with many centroids; 2^18 becomes 2^28, where squares leave 64-bit arithmetic."""
    rnd = np.random.default_rng(5)
    check(spark, [(i, rnd.integers(-1, 2, size=4)) for i in range(150)], width=4)
    check(spark, [(i, rnd.integers(-1, 2, size=4) * 2.0**18) for i in range(40)], width=4)


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(8)
    x = np.floor(rnd.normal(size=(400, 64)) * 300 + 2000 * rnd.integers(0, 4, size=(400, 1))).astype(np.int64)
    centres = x[:8]
    shape = clusters.simplex(x[:64])
    a, b = shape.apex(x), shape.apex(centres)
    exact = np.array([clusters.squared(x, np.broadcast_to(c, x.shape)) for c in centres]).T
    base = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    assert (base + (a[:, -1][:, None] - b[:, -1]) ** 2 <= exact + 1).all()
    assert (base + (a[:, -1][:, None] + b[:, -1]) ** 2 >= exact - 1).all()
    can = clusters.candidates(a, b)
    assert can[np.arange(400), exact.argmin(axis=1)].all() and can.sum() < 0.9 * can.size


def test_query_against_sql(spark, small):
    assert spark_rows(spark, "op12_simplex_clusters", small) == duckdb_rows("op12_simplex_clusters", small)
