"""Quality by a regularised quadratic discriminant over document statistics.

Each text gives ``NAMES`` statistics (sizes, shares, repetition, entropy), transformed to spread
evenly. Every class has a mean and a covariance of its own, shrunk towards the pooled covariance
and towards a multiple of the identity. The score compares the two Gaussian log-densities: a
Mahalanobis distance and a determinant from the Cholesky factor of each class, computed once.

The texts are read once, for the statistics of every row. The model is made of counts, sums and
sums of products per class, over all labelled rows that are not held out: partial sums on the
executors, two small matrices on the driver.

Defined cases: a null text counts as empty, and an empty text has all statistics at zero; a null
label is no label; a document labelled twice counts with its least label; with fewer than two rows
of either class every score is the share of label 1 (0.5 without labels); an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchline.llm.common import by_bytes, remainder, saved
from batchline.llm.words import Words, words_of

#: Weight of the pooled covariance, and of the identity, in a class's covariance.
POOLED, ROUND = 0.1, 0.02
THRESHOLD = 0.7
AT_ONCE = 4 << 20

NAMES = (
    "words", "word_length", "sentence_length", "line_length", "upper", "digits", "marks", "odd_marks", "exclaimed", "blanks",
    "different_words", "commonest_word", "repeated_at_once", "repeated_pairs", "word_entropy", "long_words", "one_letter_words",
    "repeated_lines", "closed_lines",
)

# kinds of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 plain mark, 5 odd mark, 6 ! or ?, 7 blank, 8 sentence end, 9 line end
_KIND = np.zeros(256, np.int64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_KIND[[ord(c) for c in ",;:'\"()-"]] = 4
_KIND[[ord(c) for c in "!?"]] = 6
_KIND[[9, 11, 12, 13, 32]] = 7
_KIND[ord(".")] = 8
_KIND[10] = 9
_KIND[[0xC3, 0xC4, 0xC5, *range(0xC6, 0xE2), *range(0xE3, 0xF0)]] = 1  # first bytes of letters
_KIND[[0xC2, 0xE2, *range(0xF0, 0xF8)]] = 5


def _runs(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: different codes, how often the commonest occurs, and sum of c log c."""
    if not len(code):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    key = np.sort(owner * np.int64(code.max() + 1) + code)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(first, len(key)))
    own = key[first] // np.int64(code.max() + 1)
    most = np.zeros(n)
    np.maximum.at(most, own, counts)
    return np.bincount(own, minlength=n), most, np.bincount(own, counts * np.log(counts), minlength=n)


def _lines(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: lines that are not blank, those that are repeats, those that end in . ! or ?"""
    split = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.ascii_trim_whitespace(split.flatten())
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    closed = pc.match_substring_regex(flat, r"[.!?]$").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), counts)[real]
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[real]
    different, _, _ = _runs(owner, code, n)
    lines = np.bincount(owner, minlength=n)
    return lines, lines - different, np.bincount(owner, closed[real], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """Texts x ``NAMES``."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words: Words = words_of(texts)
    count = np.diff(words.edges).astype(float)
    owner, code = words.owner, words.code.astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    of_byte = np.repeat(np.arange(n) * 10, np.diff(offsets)) + _KIND[raw]
    kinds = np.bincount(of_byte, minlength=10 * n).reshape(n, 10).astype(float)
    signs = np.maximum(1.0, kinds[:, 1:].sum(axis=1))
    letters = np.maximum(1.0, kinds[:, 1] + kinds[:, 2])
    length = np.array([len(w) for w in words.distinct], float)
    of_word = length[code] if len(code) else np.zeros(0)
    some = np.maximum(1.0, count)
    different, most, entropy = _runs(owner, code, n)
    after = np.flatnonzero(owner[1:] == owner[:-1]) if len(code) else np.zeros(0, np.int64)
    again = np.bincount(owner[after], code[after] == code[after + 1], minlength=n)
    pairs = code[after] * np.int64(len(words.distinct) + 1) + code[after + 1] if len(after) else np.zeros(0, np.int64)
    _, pairs = np.unique(pairs, return_inverse=True)
    pair_kinds, _, _ = _runs(owner[after], pairs, n)
    lines, repeats, closed = _lines(texts, n)
    root = np.sqrt
    columns = {
        "words": np.log1p(count), "word_length": np.log1p(np.bincount(owner, of_word, minlength=n) / some),
        "sentence_length": np.log1p(count / (1 + kinds[:, 8] + kinds[:, 6])), "line_length": np.log1p(count / np.maximum(1, lines)),
        "upper": root(kinds[:, 2] / letters), "digits": root(kinds[:, 3] / signs), "marks": root((kinds[:, 4] + kinds[:, 8]) / signs),
        "odd_marks": root(kinds[:, 5] / signs), "exclaimed": root(kinds[:, 6] / signs), "blanks": root((kinds[:, 7] + kinds[:, 9]) / signs),
        "different_words": np.log1p(different) / np.log1p(some), "commonest_word": root(most / some),
        "repeated_at_once": root(again / some), "repeated_pairs": root(np.maximum(0, count - 1 - pair_kinds) / some) * (count > 1),
        "word_entropy": (np.log(some) - entropy / some) / np.log1p(some),
        "long_words": root(np.bincount(owner, of_word > 14, minlength=n) / some), "one_letter_words": root(np.bincount(owner, of_word == 1, minlength=n) / some),
        "repeated_lines": root(repeats / np.maximum(1, lines)), "closed_lines": closed / np.maximum(1, lines),
    }
    return np.stack([columns[c] for c in NAMES], axis=1)


@dataclass
class Gaussian:
    """A class's density; ``inverse`` is that of the Cholesky factor."""

    mean: np.ndarray
    inverse: np.ndarray
    log_scale: float  # log prior - log determinant of the factor

    def log_density(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.inverse.T
        return self.log_scale - 0.5 * (y * y).sum(axis=1)


@dataclass
class Model:
    good: Gaussian | None = None
    poor: Gaussian | None = None
    prior: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.good is None or self.poor is None:
            return np.full(len(x), self.prior)
        return 0.5 * (1 + np.tanh(0.5 * (self.good.log_density(x) - self.poor.log_density(x))))


def fit(moments: dict[int, np.ndarray], pooled: float = POOLED, round_: float = ROUND) -> Model:
    """``moments``: by class the sums of (1, x) (1, x)'."""
    counts = {k: m[0, 0] for k, m in moments.items()}
    total = sum(counts.values())
    prior = counts.get(1, 0.0) / total if total else 0.5
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return Model(prior=prior)
    means = {k: m[0, 1:] / m[0, 0] for k, m in moments.items()}
    own = {k: m[1:, 1:] / m[0, 0] - np.outer(means[k], means[k]) for k, m in moments.items()}
    common = sum(counts[k] * own[k] for k in own) / total
    parts = {}
    for k in (0, 1):
        shrunk = (1 - pooled) * own[k] + pooled * common
        # towards the identity in units of the pooled spread of each statistic
        shrunk = (1 - round_) * shrunk + round_ * np.diag(np.diag(common) + 1e-6)
        factor = np.linalg.cholesky(shrunk)
        inverse = np.linalg.inv(factor)
        parts[k] = Gaussian(means[k], inverse, float(np.log(counts[k] / total) - np.log(np.diag(factor)).sum()))
    return Model(parts[1], parts[0], prior)


# --- Spark ----------------------------------------------------------------------------------------


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every row (saved; the only pass over the texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", AT_ONCE):
                x = statistics(batch.column("text"))
                edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(edges, pa.array(x.reshape(-1)))], ["doc_id", "x"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>"
    return saved(docs.select("doc_id", "text").mapInArrow(run, schema), "statistics")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """``rows``: as from ``described``."""
    told = (
        labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .filter(remainder(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    d = len(NAMES) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _matrix(batch)])
            kind = batch.column("quality").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                total[k] += x[kind == k].T @ x[kind == k]
        at = np.arange(2 * d * d, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1))], ["at", "value"])

    parts = rows.join(told, "doc_id").select("x", "quality").mapInArrow(sums, "at int, value double")
    out = np.zeros(2 * d * d)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():  # 2 matrices
        out[row["at"]] = row["value"]
    return fit(dict(enumerate(out.reshape(2, d, d))))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``described``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = described(docs)
    out = scored(rows, train(rows, labels))
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
