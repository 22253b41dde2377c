"""From documents to packed training sequences: five stages, each a table.

``run`` applies the stages to ``documents``; each is written as parquet and read back, so a
stage's input is files that every executor sees. A stage that gets files works on them where they
lie; of any other frame it stores a copy first.

Defined cases: a null or empty text is not toxic, is one group in exact dedup (the least ``doc_id``
stays) and has no words for the mix to take; a null ``doc_id`` loses to any other in a group; of
rows with equal id and text one stays; a text of any length is read whole; an empty table passes
through all stages as an empty table; other columns, whatever their names, come with their rows up
to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from batchline.llm import exact_dedup, mixing, near_dup, packing, toxicity
from batchline.llm.common import saved, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents scored toxic go. Learned from ``labels``."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the least ``doc_id`` stays."""
    return exact_dedup.distinct_documents(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each class the document with the least ``doc_id`` stays."""
    return near_dup.unlike_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a row per copy that the mix takes, in training order."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: every row as often as it comes, in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean), ("exact_dedup", distinct), ("near_dedup", unlike), ("mix", mixed), ("pack", packed),
]

#: No SQL expresses the trained score, the alignment and the linear program; tests compare with
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
