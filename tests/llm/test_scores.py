"""Trained scores: held-out accuracy, hand-made densities, and awkward rows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from batchline.llm import language, quality, toxicity
from batchline.llm.words import words_of
from tests.llm import cases


def rest(doc_id, divisor: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor


LABELS = "doc_id long, quality int, toxic int"


def test_words():
    texts = [None, "", " ", "The hen. THE\tfox!? éÀ-x\n\n2 2", "...", "a_b"]
    words = words_of(pa.array(texts), sentences=True)
    got = [[words.distinct[c] for c in words.code[a:b]] for a, b in zip(words.edges, words.edges[1:], strict=False)]
    assert got == [[], [], [], ["the", "hen", ".", "the", "fox", ".", "éà", "x", ".", "2", "2"], ["."], ["a", "b"]]


# --- quality


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98


def test_density_is_the_gaussian():
    rnd = np.random.default_rng(2)
    x = {0: rnd.normal(0, 2, (300, 3)) @ rnd.normal(size=(3, 3)), 1: rnd.normal(1, 1, (500, 3))}
    moments = {k: np.column_stack([np.ones(len(v)), v]).T @ np.column_stack([np.ones(len(v)), v]) for k, v in x.items()}
    model = quality.fit(moments, pooled=0.0, round_=0.0)
    at = rnd.normal(size=(20, 3))
    logs = {}
    for k, v in x.items():
        mean, cov = v.mean(0), np.cov(v.T, bias=True)
        gap = at - mean
        logs[k] = np.log(len(v) / 800) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * (gap @ np.linalg.inv(cov) * gap).sum(1)
    assert model.score(at) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))
    assert (quality.fit({0: moments[0] * 0, 1: moments[1]}).score(at) == 1).all()  # one class only
    assert (quality.fit({0: moments[0] * 0, 1: moments[1] * 0}).score(at) == 0.5).all()


def test_statistics_do_not_depend_on_the_batch():
    texts = [r[1] for r in cases.awkward()] + ["AB ab AB ab.", "x x x x", "one line\none line\n\nlast"]
    together = quality.statistics(pa.array(texts, pa.string()))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.isfinite(together).all() and np.allclose(together, alone)
    assert (together[0] == together[1]).all() and (together[1] == 0).all()
    at = {n: together[-2][quality.NAMES.index(n)] for n in quality.NAMES}
    assert at["repeated_at_once"] == pytest.approx(np.sqrt(3 / 4)) and at["commonest_word"] == 1
    assert together[-1][quality.NAMES.index("repeated_lines")] == pytest.approx(np.sqrt(1 / 3))


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(i, q, 0) for i, q in [(1, 0), (2, None), (4, 1), (4, 0), (8, 0), (9, 0), (10, 1), (11, 1), (12, 1), (None, 1), (77, 1)]], LABELS)
    rows = quality.report(cases.table(spark), labels).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r[0] or 0) for r in cases.awkward())
    for r in rows:
        assert r["held_out"] == (rest(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.report(cases.table(spark), none).collect()} == {0.5}
    assert quality.report(cases.table(spark, []), labels).collect() == []


# --- toxicity


def test_toxicity_held_out_and_places(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97  # some junk labelled toxic holds nothing that is
    assert sum(r["toxic"] for r in rows) > 20
    assert all(not r["offences"] or r["predicted"] for r in rows) and any(r["offences"] for r in rows)


def test_gradient_is_that_of_the_likelihood():
    rnd = np.random.default_rng(3)
    bag = toxicity.Bags(np.array([0, 1, 1, 3, 4]), np.array([0, 1, 2, 1, 0]), np.array([0, 2, 4, 6]))
    toxic = np.array([True, False, True])

    def loss(w, b):
        p = 1 / (1 + np.exp(-bag.sentence_scores(w, b)))
        clear = np.array([np.prod(1 - p[i:j]) for i, j in zip(bag.edges, bag.edges[1:], strict=False)])
        return -np.log(np.where(toxic, 1 - clear, clear)).sum()

    weights, bias = toxicity.fit(bag, toxic, 3, steps=1500)
    start = loss(np.zeros(3), -10.0)
    assert loss(weights, bias) < 0.2 * start
    assert rnd is not None and weights[0] > 0 > weights[1] - weights[0]


def test_offending_sentences_are_found(spark):
    bad = ["zorgle", "zorglish", "vexum"]
    rows, labels, marked = [], [], {}
    for i in range(400):
        parts = [s for s in (cases.prose(i, 45) + ".").split(".") if s.strip()]
        if i % 4 == 0:
            at = i % len(parts)
            parts[at] = parts[at] + " " + bad[i % 3]
            marked[i] = bad[i % 3]
        rows.append((i, ".".join(parts) + "."))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = cases.documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    for r in toxicity.scored(docs, model, places=True).collect():
        assert (r["score"] >= 0.5) == (r["doc_id"] in marked)
        spans = [r["text"][o["begin"] : o["end"]] for o in r["offences"]]
        assert len(spans) == (r["doc_id"] in marked)
        for span in spans:
            assert marked[r["doc_id"]] in span and not re.search(r"[.!?\n]", span)


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(i, 0, t) for i, t in [(1, 0), (2, None), (4, 1), (4, 0), (8, 0), (9, 0), (10, 1), (11, 1), (12, 1), (None, 1), (77, 1)]], LABELS)
    rows = toxicity.report(cases.table(spark), labels).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r[0] or 0) for r in cases.awkward())
    for r in rows:
        assert r["held_out"] == (rest(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    none = spark.createDataFrame([], LABELS)
    docs = cases.table(spark)
    left = toxicity.clean_documents(docs, none)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert toxicity.report(cases.table(spark, []), labels).collect() == []


# --- language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97


def test_filters_return_every_language_that_has_a_gram():
    rnd = np.random.default_rng(5)
    names = [f"l{i:02d}" for i in range(70)]  # more than one slice
    grams = {n: rnd.integers(0, 1 << 62, 300).astype(np.uint64) for n in names}
    shared = rnd.integers(0, 1 << 62, 20).astype(np.uint64)
    for n in names[::2]:
        grams[n] = np.concatenate([grams[n], shared])
    filters = language.Filters.build(grams)
    assert filters.languages == names and filters.slices.shape[0] == 2
    has = lambda values, i: (filters.masks(values)[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
    for i, n in enumerate(names):
        assert has(grams[n], i).all()  # never misses one
        assert has(shared, i).mean() <= (1.0 if i % 2 == 0 else 0.2)
    others = rnd.integers(0, 1 << 62, 20_000).astype(np.uint64)
    for i in (0, 1, 69):
        assert abs(has(others, i).mean() - filters.false[i]) < 0.01


def test_grams_against_a_loop():
    words = words_of(pa.array(["ab abc été", "x ab"]))
    values, edges = language.grams_of(words)
    parts = {}
    for k, word in enumerate(words.distinct):
        padded = f" {word} "
        want = sum(max(0, len(padded) - n + 1) for n in language.GRAMS)
        assert edges[k + 1] - edges[k] == want
        parts[word] = set(values[edges[k] : edges[k + 1]].tolist())
    assert len(parts["ab"] & parts["abc"]) == 1  # the beginning " ab"


def test_language_awkward_rows(spark):
    rows = language.report(cases.table(spark)).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r[0] or 0) for r in cases.awkward())
    for r in rows:
        assert r["held_out"] == (rest(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
    unknown = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert unknown >= {1, 2, 3, 8} and not unknown & {4, 5, 6, 9, 10}
    no_lang = cases.table(spark, [(i, t, None, s, n, x, y, z) for i, t, _, s, n, x, y, z in cases.awkward()])
    assert {r["lang_pred"] for r in language.report(no_lang).collect()} == {"und"}
    assert language.report(cases.table(spark, [])).collect() == []


def test_training_rows_are_bounded_where_doc_ids_repeat(spark):
    own = [i for i in range(200) if rest(i, 5)][:20]
    docs = cases.documents(spark, [(i, f"text {i}") for i in own] + [(own[0], f"again {k}") for k in range(300)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in own], LABELS)
    rows = toxicity.training_rows(docs, labels, 20).collect()
    assert len(rows) == 20 and {r["text"] for r in rows} == {"again 0", *(f"text {i}" for i in own[1:])}


def test_language_rank_is_limited_before_the_shuffle(spark, monkeypatch):
    plans, write = [], language.saved
    monkeypatch.setattr(language, "saved", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or write(df, label))
    language.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang"))
    assert "WindowGroupLimit" in plans[0] and "BroadcastHashJoin" in plans[1]


def test_language_training_is_bounded_where_doc_ids_repeat(spark, monkeypatch):
    own = [i for i in range(200) if rest(i, 3) != 1][:30]
    pairs = [(i, f"text {i}", "en") for i in own] + [(own[0], f"again {k}", "en") for k in range(300)] + [(own[1], "texte", "fr")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string, lang string").repartition(3)
    assert len([r for r in language.training_rows(docs, 30).collect() if r["lang"] == "en"]) == 30
    rows = language.training_rows(docs, 10)
    texts = [r["text"] for r in rows.collect() if r["lang"] == "en"]
    assert len(texts) == 10 and rows.count() == 11
    monkeypatch.setattr(language, "PARTS", 3)
    assert sorted(texts) == sorted(r["text"] for r in language.training_rows(docs, 10).collect() if r["lang"] == "en")
