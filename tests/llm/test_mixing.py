"""The mix against sums made by hand."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchline.llm import mixing
from tests.llm import cases


def size(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def waterfill(sizes: dict, weights: dict, most: float = 3.0) -> dict:
    """Reshare the excess by weight, one round after the other."""
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            return target
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        target |= share
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
            capped.add(s)
            left -= target[s]


def check(rows, docs, taken="taken"):
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += size(d["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    expected = waterfill(dict(sizes), weights)
    words = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        words[r["source"]] += r["taken"]
    for s, target in expected.items():
        assert abs(words[s] - target) <= 0.5 + 1e-6


def test_targets_stop_at_three_times_the_size():
    rnd = np.random.default_rng(4)
    for _ in range(50):
        sizes = rnd.integers(0, 1000, 7) * (rnd.random(7) < 0.8)
        weights = np.array([5.0, 2, 1, 5, 2, 1, 5])
        got = mixing.targets(sizes.astype(float), weights)
        names = range(7)
        want = waterfill({i: int(sizes[i]) for i in names}, {i: float(weights[i]) for i in names}) if sizes.sum() else dict.fromkeys(names, 0)
        assert got == pytest.approx([want[i] for i in names])
        assert got.sum() == pytest.approx(sizes.sum())


def test_time_is_the_inverse_of_demand(spark):
    for knots in mixing.SCHEDULES:
        pieces = mixing.integrated(knots)
        times = [i / 40 for i in range(41)]
        shares = [mixing.due(pieces, t) for t in times]
        assert shares[0] == 0 and shares[-1] == pytest.approx(1) and shares == sorted(shares)
        got = spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.time_of(F.col("s"), pieces).alias("t")).collect()
        assert [r["t"] for r in got] == pytest.approx(times, abs=1e-9)


def test_mix_of_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    rows = mixing.assigned(docs).select("doc.doc_id", "source", "size", "source_size", "target", "taken").collect()
    check(rows, docs.collect())
    again = mixing.report(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_ranges_do_not_change_the_mix(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    before = sorted(map(tuple, mixing.report(docs).collect()))
    monkeypatch.setattr(mixing, "RANGE", 10)
    assert sorted(map(tuple, mixing.report(docs).collect())) == before


def test_copies_follow_the_schedule(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    each = mixing.copies(docs).select("doc.doc_id", "doc.source", "copy", "words", "size", "time").collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.report(docs).collect()}
    words = Counter()
    for r in each:
        assert 0 <= r["time"] <= 1 and 0 < r["words"] <= r["size"]
        words[r["doc_id"]] += r["words"]
    assert words == Counter({k: v for k, v in taken.items() if v})
    order = sorted({r["source"] for r in each})
    for i, source in enumerate(order):  # demand met by the middle of the training, document by document
        own = [r for r in each if r["source"] == source]
        total = sum(r["words"] for r in own)
        half = sum(r["words"] for r in own if r["time"] <= 0.5)
        due = mixing.due(mixing.integrated(mixing.SCHEDULES[i % 3]), 0.5)
        assert abs(half - due * total) <= max(r["words"] for r in own)
    laid = mixing.in_order(docs)
    assert laid.columns == docs.columns
    assert sum(size(r["text"]) for r in laid.collect()) == sum(taken.values())


def test_awkward_rows(spark):
    docs = cases.table(spark)
    check(mixing.assigned(docs).collect(), docs.collect())
    laid = mixing.in_order(docs)
    assert laid.columns == docs.columns
    assert sum(size(r["text"]) for r in laid.collect()) == sum(r["taken"] for r in mixing.report(docs).collect())
    assert mixing.report(cases.table(spark, [])).collect() == [] == mixing.in_order(cases.table(spark, [])).collect()
    wordless = mixing.report(cases.table(spark, [r for r in cases.awkward() if not (r[1] or "").strip()])).collect()
    assert len(wordless) == 3 and all(r["taken"] == 0 == r["target"] for r in wordless)
