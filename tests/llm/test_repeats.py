"""Periodic runs against every period tried at every place."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from batchline.llm import queries, repeats
from tests.llm.cases import awkward, documents, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Begin, length, period of all runs, by the definition."""
    n, out = len(words), []
    x = np.array([hash(w) for w in words])
    for q in range(1, n // 4 + 1):
        equal = x[q:] == x[:-q]
        if np.count_nonzero(equal) < 3 * q:
            continue
        same = np.concatenate([[False], equal, [False]])
        step = np.diff(same.astype(int))
        for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            length = e - s + q
            root = words[s : s + q]
            if length >= max(6, 4 * q) and not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                out.append((int(s), int(length), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = changed(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), s, length, q, None if q is None else 1000 * length // q,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def of(texts):
    """Runs of each list of letters, all in one batch."""
    edges = np.cumsum([0, *map(len, texts)])
    ids = np.array([d * 1000 + ord(w) for d, t in enumerate(texts) for w in t], np.int64)
    _, ids = np.unique(ids, return_inverse=True) if len(ids) else (None, ids)
    begin, end, q = repeats.find_runs(ids, edges)
    out = [[] for _ in texts]
    for b, e, period in zip(begin.tolist(), end.tolist(), q.tolist(), strict=True):
        d = int(np.searchsorted(edges, b, side="right")) - 1
        out[d].append((b - int(edges[d]), e - b, period))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab", max_size=40) | st.text("abc", max_size=60), max_size=4))
def test_short_strings(texts):
    assert of(texts) == [brute(list(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", min_size=1, max_size=14), st.integers(1, 12), st.text("abcd", max_size=6)), max_size=8))
def test_planted_powers(parts):
    text = "".join(root * times + rest for root, times, rest in parts)
    assert of([text, text[::-1], "x" + text]) == [brute(list(t)) for t in (text, text[::-1], "x" + text)]


def fibonacci(n):
    a, b = "b", "a"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("text", ["a" * 4000, "ab" * 1500 + "a", fibonacci(3000), ("abcabd" * 40 + "x") * 9, "".join(f"{i % 37 * i % 11}" for i in range(3000))])
def test_long_strings(text):
    assert of([text]) == [brute(list(text))]


def test_grammar_derives_the_text():
    """Expanding the start rule gives the words back; no pair occurs twice without overlap."""
    ids = np.array([ord(c) for c in "abracadabra" * 7 + "aaaaaaaaaaa" + "abcabc"])
    g = repeats.repair(ids, np.array([0, len(ids)]))
    by_rule = {}
    for r, b, m, e in zip(g.rule, g.begin, g.middle, g.end, strict=True):
        assert b < m < e
        text = tuple(ids[b:e])
        assert by_rule.setdefault(r, (text, m - b)) == (text, m - b)
    assert len(by_rule) < len(g.rule) and len(g.top) < 30


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_awkward_rows(spark):
    rows = awkward() + [(20 + i, " ".join("ab cd ef".split()[: 1 + i % 3] * (i + 2)), "en", "a", 1, 0.5, "n", None) for i in range(12)]
    got = [tuple(r[c] for c in COLUMNS) for r in repeats.report(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)


def test_empty_table(spark):
    assert repeats.report(table(spark, [])).collect() == []


def test_spans_and_text(spark):
    docs = documents(spark, [(1, prose(4, 30) + " la" * 9 + " end"), (2, None), (3, "no runs here")])
    assert [tuple(r) for r in repeats.spans(docs).collect()] == [(1, 30, 9, 1)]
    texts = {r["doc_id"]: r["collapsed"] for r in repeats.periodic_runs(docs).collect()}
    assert texts == {1: prose(4, 30) + " la end", 2: "", 3: "no runs here"}


def test_whole_table(spark, small):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op13_grammar_runs(spark, small).collect())
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(expected(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] for r in got) > 0
