"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are counted by encoded length (partial sums before the shuffle), so what follows grows
with the number of different lengths only. Sums over the longer lengths then answer, for any
context limit: how many documents and tokens there are, how many fit, how many tokens remain when
every document is cut at the limit, and quantiles. The sums are made per range of lengths first
and then inside the ranges, so no task has all lengths.

Defined cases: null text counts as empty and has no ids (one with ``end=True``); an empty table
gives no rows; repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchline.llm.common import saved
from batchline.llm.tokens import Encoder, default_path, over_texts

#: Lengths per range of the two-step sums.
RANGE = 1024


def token_counts(docs: DataFrame, end: bool = False, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every document."""

    def work(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = encoder.lengths_of(batch.column("text")) + int(end)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64))], ["doc_id", "n_tokens"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long"
    return docs.select("doc_id", "text").mapInArrow(over_texts(path or default_path(), work), schema)


def histogram(docs: DataFrame, end: bool = False, path: str | None = None) -> DataFrame:
    """``n_tokens, docs``: how many documents have each encoded length."""
    return token_counts(docs, end, path).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limits(counted: DataFrame) -> DataFrame:
    """The suffix sums at every length that occurs, taken as a context limit.

    ``n_tokens, docs``; ``docs_longer, tokens_longer``: documents over the limit and their tokens;
    ``docs_total, tokens_total``; ``tokens_within``: tokens of documents that fit;
    ``tokens_cut``: tokens if each document is cut at the limit; ``share``: documents that fit,
    as a share of all. Between two lengths only ``tokens_cut`` changes, by ``docs_longer`` a token
    (see ``cut_at``), so these rows answer every limit.
    """
    held = saved(counted, "lengths").withColumn("part", F.floor(F.col("n_tokens") / RANGE))
    tokens = F.col("docs") * F.col("n_tokens")
    parts = held.groupBy("part").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    bases = parts.select(
        "part",
        *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"),
        F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"),
    )
    above = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = held.select(
        "part", "n_tokens", "docs",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("d"),
        F.coalesce(F.sum(tokens).over(above), F.lit(0)).alias("t"),
    )
    out = longer.join(bases, "part").select(
        "n_tokens", "docs", (F.col("d") + F.col("d_later")).alias("docs_longer"),
        (F.col("t") + F.col("t_later")).alias("tokens_longer"), "docs_total", "tokens_total",
    )
    return out.withColumns(
        {
            "tokens_within": F.col("tokens_total") - F.col("tokens_longer"),
            "tokens_cut": F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens"),
            "share": (F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total"),
        }
    )


def cut_at(sums: DataFrame, limit: int) -> DataFrame:
    """``docs_within, tokens_cut`` at any limit: one row, from the next length below it."""
    below = sums.filter(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("*"), "n_tokens").alias("r"))
    totals = sums.agg(F.max("docs_total").alias("docs"))
    at = below.join(totals).select(
        F.coalesce(F.col("r.docs_total") - F.col("r.docs_longer"), F.lit(0)).alias("docs_within"),
        (F.coalesce(F.col("r.tokens_within"), F.lit(0)) + F.coalesce(F.col("r.docs_longer"), F.col("docs"), F.lit(0)) * limit).alias("tokens_cut"),
    )
    return at


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The least length within which at least ``share`` of all documents lie."""
    return sums.filter(F.col("share") >= share).agg(F.min("n_tokens").alias("n_tokens"))
