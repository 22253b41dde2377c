"""The vector join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchline.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n_links long"


def brute(rows, cosine=0.98):
    """Links of each row and the least id of its component, by position."""
    able = []
    for _, v, label in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None
        able.append(np.array(v, np.float32).astype(float) if ok else None)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = able[i], able[j]
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2]:
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        least[find(i)] = min(vec, least.get(find(i), vec))
    return [(rows[i][0], links[i], least[find(i)]) for i in range(len(rows))]


def check(spark, rows):
    frame = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "n", 5) for i, v, label in rows], SCHEMA).repartition(3)
    got = vectors.report(frame).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(brute(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("chunk", [1000, 4])
def test_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rnd = np.random.default_rng(11)
    rows, at = [], 0
    for d in (64, 20, 3):
        for c in range(12):
            centre = rnd.normal(size=d)
            for _ in range(rnd.integers(1, 9)):  # near the limit of 0.98, on either side
                rows.append((at, centre * rnd.uniform(0.1, 10) + rnd.normal(size=d) * rnd.uniform(0, 0.25), c % 3))
                at += 1
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(6)]  # exact copies
    check(spark, [(i, v.astype(np.float32).tolist(), label) for i, v, label in rows])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_exact_ties_with_the_limit(spark, kind):
    """Integer vectors whose cosine is 0.98 to the last bit are linked, at several widths."""
    rows = []
    for label, d in enumerate((4, 8, 16, 64)):
        for scale in (1, 3, 1024):
            for shift in range(3):
                a, b = np.zeros(d), np.zeros(d)
                a[shift : shift + 1], b[shift : shift + 1] = scale, -scale
                for v in (a, b):
                    v[[(shift + 1) % d, (shift + 2) % d, (shift + 3) % d]] = np.array([1, -7, 7]) * scale
                rows += [(len(rows), a.tolist(), label), (len(rows) + 1, b.tolist(), label)]
    want = [(i, n, c) for i, n, c in brute(rows)]
    assert min(n for _, n, _ in want) > 0
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    got = vectors.report(frame).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(want)


def test_awkward_rows(spark):
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
        (7, [1.0, 2.0], None), (8, [1.0, 2.0], None), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0], 2), (12, [1.0, 2.0, 0.0], 1),
        (13, [-1.0, -2.0], 1), (14, [1e-30, 2e-30], 1), (15, [1e30, 2e30], 1), (16, [5.0], 3), (17, [7.0], 3), (18, [-7.0], 3), (19, [0.0, -0.0], 1), (9, [1.0, 2.0], 1),
    ]
    check(spark, rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.report(empty).collect() == []


def test_whole_table(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.report(frame).collect())
    x = np.array([v for _, v, _ in rows], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    same = np.equal.outer([r[2] for r in rows], [r[2] for r in rows])
    near = (x @ x.T >= 0.98) & same
    assert [n for _, n, _ in got] == [int(k) for _, k in sorted(zip([r[0] for r in rows], near.sum(1) - 1, strict=True))]


def test_every_link_is_within_budget_in_some_block():
    """The pigeonhole itself: a rotated difference within the whole budget is within one share."""
    rnd = np.random.default_rng(1)
    for d in (3, 20, 64):
        for _ in range(200):
            gap = rnd.normal(size=d) * rnd.random(d) ** 4
            gap *= np.sqrt(0.04) / np.linalg.norm(gap)
            turned = gap @ vectors.rotation(d)
            assert any((turned[a:b] ** 2).sum() <= vectors.radius2(d, k, 0.98) for k, (a, b) in enumerate(vectors.blocks(d)))
    assert F is not None
