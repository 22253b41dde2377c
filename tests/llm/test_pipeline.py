"""The pipeline's stages over a whole small table, each against a plain version of itself."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from batchline.llm import mixing, near_dup, toxicity
from batchline.llm.common import held, saved
from batchline.llm.packing import CAPACITY
from tests.llm import cases


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mix", "pack"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], small), name))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    score = {r["doc_id"]: r["score"] for r in toxicity.report(docs, labels).collect()}
    assert {r["doc_id"] for r in rows[1]} == {d for d, s in score.items() if s < 0.5}
    by_text = defaultdict(list)
    for r in rows[1]:
        by_text[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(min(v) for v in by_text.values())
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(r["doc_id"] for r in near_dup.report(tables[2]).collect() if r["kept"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.report(tables[3]).collect()}
    words = Counter()
    for r in rows[4]:
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == Counter({k: v for k, v in taken.items() if v})
    filled = Counter()
    for r in rows[5]:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= CAPACITY
    assert Counter(r["doc_id"] for r in rows[5] if r["piece"] == 0) == Counter(r["doc_id"] for r in rows[4])


def test_a_stage_reads_its_input_where_it_lies(spark, tmp_path):
    """No copy of a table of files; one of anything else."""
    path = f"{tmp_path}/docs"
    cases.table(spark).write.parquet(path)
    for whole in (spark.read.parquet(path), spark.read.parquet(f"file:{path}"), spark.read.schema(cases.SCHEMA).parquet(f"file://{path}")):
        assert held(whole, "x") is whole
    for some in (whole.filter("doc_id > 3"), whole.withColumn("text", F.upper("text")), cases.table(spark), whole.union(whole)):
        assert held(some, "x") is not some


def test_stages_bear_awkward_and_empty_tables(spark, small):
    for docs in (cases.table(spark), cases.table(spark, [])):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            before, kept = kept, saved(stage(spark, kept, small), name)
            if name != "pack":
                assert kept.columns == docs.columns
        assert bool(before.count()) == bool(kept.count())
