"""Registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from batchline.llm import clusters, exact_dedup, language, lengths, mixing, near_dup, packing, quality, rans, repeats, toxicity, url_templates, vectors
from batchline.llm.common import table


def op1_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"))


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(spark, f"{sf_dir}/documents.parquet")


def op8_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op9_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.report(table(spark, sf_dir, "embeddings"))


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limits(lengths.histogram(table(spark, sf_dir, "documents")))


def op11_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.report(table(spark, sf_dir, "pages"))


def op12_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(table(spark, sf_dir, "embeddings"))


def op13_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quadratic_discriminant, op2_best_fit_packing, op3_curriculum_mix, op4_rans_tokens, op5_order_minhash,
        op6_noisy_or_toxicity, op7_stream_dedup, op8_language_filters, op9_subspace_join, op10_length_histogram,
        op11_path_templates, op12_simplex_clusters, op13_grammar_runs,
    )
}
ORACLE: dict[str, str] = {
    "op7_stream_dedup": """
        WITH digests AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
          count(*) OVER (PARTITION BY text_sha256) AS group_size,
          doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM digests""",
    "op12_simplex_clusters": clusters.oracle(),
}
