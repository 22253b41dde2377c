"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchline.llm import exact_dedup, near_dup
from batchline.llm.common import saved
from batchline.llm.links import components
from tests.llm import cases


def folder_of(df) -> str:
    return saved(df, "input").scratch_path


def normal(text) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact(rows) -> dict:
    groups = defaultdict(list)
    for doc, text in rows:
        groups[normal(text)].append(doc)
    return {t: (min((d for d in ids if d is not None), default=None), len(ids)) for t, ids in groups.items()}


def check_exact(report, rows):
    groups = exact(rows)
    want = Counter()
    for doc, text in rows:
        keep, n = groups[normal(text)]
        want[doc, keep, n, hashlib.sha256(normal(text).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in report) == want
    kept = Counter(r["text_sha256"] for r in report if r["kept"])
    assert len(kept) == len(groups) and set(kept.values()) <= {1}


@pytest.mark.parametrize("batches", [1, 4])
def test_exact_whole_table(spark, small, batches):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_exact(exact_dedup.report(spark, folder_of(docs.repartition(4)), batches).collect(), rows)
    check_exact(exact_dedup.report(spark, f"{small}/documents.parquet", batches).collect(), rows)  # one file


def test_exact_awkward_rows(spark):
    docs = cases.table(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_exact(exact_dedup.report(spark, folder_of(docs), 3).collect(), rows)
    left = exact_dedup.distinct_documents(docs)
    assert left.columns == docs.columns
    assert Counter(normal(r["text"]) for r in left.collect()) == Counter(set(normal(t) for _, t in rows))
    empty = cases.table(spark, [])
    assert exact_dedup.report(spark, folder_of(empty)).collect() == [] == exact_dedup.distinct_documents(empty).collect()


def test_digest_that_stands_for_two_texts(spark):
    """A digest of one hex digit: only the comparison of whole texts tells groups apart."""
    docs = cases.documents(spark, [(i, f"text {i % 40}") for i in range(120)])
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    path = folder_of(docs)
    rows = exact_dedup.decisions(spark, path, docs.schema, 2, weak).collect()
    assert sorted(r["at"]["doc_id"] for r in rows if r["at"] == r["first"]) == list(range(40))
    assert {r["n"] for r in rows} == {3} and len(rows) == 120


def test_state_goes_on_with_new_files(spark):
    """A later run over the same folder reads only new files and remembers the old ones."""
    folder, path = folder_of(cases.documents(spark, [])), folder_of(cases.documents(spark, [(5, "a"), (6, "b")]))
    schema = cases.documents(spark, []).schema
    exact_dedup.remember(spark, path, schema, folder=folder).collect()
    cases.documents(spark, [(1, "a"), (7, "c")]).write.mode("append").parquet(path)
    state = exact_dedup.remember(spark, path, schema, folder=folder).collect()
    assert sorted((r["first"]["doc_id"], r["n"]) for r in state) == [(1, 2), (6, 1), (7, 1)]


def test_state_takes_late_files_of_an_old_time(spark):
    folder, path = folder_of(cases.documents(spark, [])), folder_of(cases.documents(spark, [(5, "a")]))
    schema = cases.documents(spark, []).schema
    exact_dedup.remember(spark, path, schema, folder=folder).collect()
    before = set(Path(path).glob("*.parquet"))
    cases.documents(spark, [(1, "a"), (7, "c")]).write.mode("append").parquet(path)
    for late in set(Path(path).glob("*.parquet")) - before:
        os.utime(late, (time.time() - 30 * 86400,) * 2)
    state = exact_dedup.remember(spark, path, schema, folder=folder).collect()
    assert sorted((r["first"]["doc_id"], r["n"]) for r in state) == [(1, 2), (7, 1)]


# --- near duplicates


def labelled(text) -> list:
    """Labelled five-word shingles."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    seen, out = Counter(), []
    for i in range(max(1, len(words) - 4)) if words else []:
        gram = tuple(words[i : i + 5])
        out.append((gram, seen[gram]))
        seen[gram] += 1
    return out


def similarity(a: list, b: list) -> float:
    """Aligned share by the full dynamic program; equal sequences are 1."""
    if not a or not b:
        return 0.0
    row = np.zeros(len(b) + 1, int)
    for x in a:
        hit = np.array([x == y for y in b])
        new = row.copy()
        new[1:] = np.maximum(new[1:], np.where(hit, row[:-1] + 1, 0))
        row = np.maximum.accumulate(new)
    m = int(row[-1])
    return m / (len(a) + len(b) - m)


def classes_of(rows) -> dict:
    parts = defaultdict(set)
    for r in rows:
        parts[r["class_id"]].add(r["doc_id"])
    return parts


def brute(rows) -> dict:
    """Least id of each row's class, all pairs aligned."""
    grams = [labelled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if set(grams[i]) & set(grams[j]) and similarity(grams[i], grams[j]) >= near_dup.SIMILARITY:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    return {i: min(ids[find(i)], key=lambda d: (d is None, d or 0)) for i in range(len(rows))}


def edited(text: str, step: int, word: str) -> str:
    words = text.split()
    return " ".join(word if i % step == step - 1 else w for i, w in enumerate(words))


def test_near_duplicates_against_all_pairs(spark):
    rows = [(i, cases.prose(i, 150)) for i in range(12)]
    rows += [(100 + 10 * i + k, edited(t, step, f"new{k}")) for i, t in rows[:8] for k, step in enumerate((70, 50, 30, 12))]
    shared = cases.prose(99, 40)  # a passage in otherwise different texts
    rows += [(300 + i, shared + " " + cases.prose(200 + i, 60)) for i in range(15)]
    rows += [(400 + i, cases.prose(500, 120) + f" tail{i} " + cases.prose(500, 3)) for i in range(30)]  # a large group
    got = {r["doc_id"]: r for r in near_dup.report(cases.documents(spark, rows)).collect()}
    want = brute(rows)
    assert {d: got[d]["class_id"] for d, _ in rows} == {d: want[i] for i, (d, _) in enumerate(rows)}
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


@pytest.mark.parametrize("chunk", [1000, 3])
def test_chains_whatever_the_chunks(spark, monkeypatch, chunk):
    """Chains in which the ends are unlike: every cell size gives the same classes."""
    monkeypatch.setattr(near_dup, "CHUNK", chunk)
    monkeypatch.setattr(near_dup, "COLUMNS", 4 * chunk)
    rows = []
    for g in range(6):
        words = cases.prose(40 + g, 200).split()
        for k in range(8):  # each step changes some more words
            rows.append((10 * g + k, " ".join(words)))
            for j in range(k * 24 + 3, k * 24 + 8):
                words[j] = f"w{g}x{k}x{j}"
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.report(cases.documents(spark, rows)).collect()}
    assert got == {d: want[i] for i, (d, _) in enumerate(rows)}


def test_pair_whose_buckets_have_a_third_text_as_least_node(spark):
    """Every bucket that the pair shares is led by a text that has only a few shingles of it."""
    rng, width = np.random.default_rng(11), near_dup.BAND
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    sketches = lambda texts: {r["key"]: r for r in near_dup.sketched(cases.documents(spark, texts)).drop("shingles").collect()}
    bands = lambda row: [tuple(row["sketch"][k : k + width]) for k in range(0, near_dup.SKETCHES, width)]
    agree = lambda p, q: sum(x == y for x, y in zip(p["sketch"], q["sketch"], strict=True))
    x = [word() for _ in range(104)]
    pairs = [[(2 * k, " ".join(x + [tail])), (2 * k + 1, " ".join([*x[:20], "other", *x[21:60], "other", *x[61:], tail]))] for k, tail in enumerate(word() for _ in range(30))]
    rows = sketches([t for pair in pairs for t in pair])
    # the pair whose lesser node is greatest, so that there is room for lesser ones
    own = max(range(30), key=lambda k: min(rows[2 * k]["node"], rows[2 * k + 1]["node"]))
    pair, (p, q) = pairs[own], (rows[2 * own], rows[2 * own + 1])
    assert similarity(*(labelled(text) for _, text in pair)) >= 0.8
    words = pair[0][1].split()
    value = near_dup._shingles(np.fromiter(map(near_dup.xxhash.xxh64_intdigest, words), np.uint64), np.array([0, len(words)]), near_dup.WORDS)[0]
    shared = [b for b, (m, n) in enumerate(zip(bands(p), bands(q), strict=True)) if m == n]
    assert shared
    tries = []
    for b in shared:
        least = [np.argsort(near_dup.mixed(value ^ near_dup.mixed(np.array([s + 1], np.uint64))))[: near_dup.KEPT] for s in range(b * width, b * width + width)]
        places = sorted({int(i) for at in least for i in at})
        for _ in range(100):
            text = [w for i in places for w in (*words[i : i + near_dup.WORDS], word())]
            tries.append((1000 + len(tries), " ".join(text), b))
    found = sketches([t[:2] for t in tries])
    third = {}
    for doc, text, b in tries:
        r = found[doc]
        if bands(r)[b] == bands(p)[b] and r["node"] < min(p["node"], q["node"]) and max(agree(r, p), agree(r, q)) < near_dup.AGREED:
            third[b] = (doc, text)
    assert set(third) == set(shared)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.report(cases.documents(spark, pair + list(third.values()))).collect()}
    assert got[2 * own] == got[2 * own + 1] == 2 * own and all(got[doc] >= 1000 for doc, _ in third.values())


def test_alignment_keeps_order_and_band():
    rnd = np.random.default_rng(7)
    for _ in range(60):
        a = rnd.permutation(300)[: rnd.integers(20, 120)].astype(np.uint32)
        b = np.delete(a, rnd.integers(0, len(a), rnd.integers(0, 6)))
        b = np.insert(b, rnd.integers(0, len(b), 2), 1000 + rnd.integers(0, 50, 2)).astype(np.uint32)
        want = similarity(list(a), list(b))
        got = near_dup.aligned(a, b)
        assert got == pytest.approx(want) if want >= near_dup.SIMILARITY else got < near_dup.SIMILARITY
    x = np.arange(100, dtype=np.uint32)
    assert near_dup.aligned(x, np.concatenate([x[50:], x[:50]])) < 0.8  # the same shingles in another order


def test_near_awkward_rows(spark):
    docs = cases.table(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    short = [(d, (t or "")[:3000]) for d, t in rows]
    want = brute(short)
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dup.report(docs).collect())
    expected = Counter()
    for i, (d, t) in enumerate(short):
        expected[d, want[i] if labelled(t) else d] += 1
    assert got == expected
    left = near_dup.unlike_documents(docs)
    assert left.columns == docs.columns
    n_classes = len({want[i] for i, (_, t) in enumerate(short) if labelled(t)}) + sum(not labelled(t) for _, t in short)
    assert left.count() == n_classes
    empty = cases.table(spark, [])
    assert near_dup.report(empty).collect() == [] == near_dup.unlike_documents(empty).collect()


def test_components(spark):
    rnd = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert all(got.get(n, n) == c for n, c in root.items()) and set(got) >= set(root) - loops
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
