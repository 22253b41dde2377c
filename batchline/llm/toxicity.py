"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's probability is logistic in the features it has; a document's is the noisy-or of its
sentences, 1 - prod(1 - p). Only documents carry labels: the weights are fitted to them by
gradient steps through the noisy-or, and the fitted sentence probabilities then say where in a
text the offence lies.

Features are words and the first 4 to 8 letters of longer words, as often as a sentence has them. Their document frequencies
by label are counted over the labelled training rows, and the ``FEATURES`` that tell the labels
apart best (chi-square) are kept. Training rows are the ``TRAIN`` labelled ones with the least
hash of ``doc_id`` (a documented bound; all of them where there are fewer): whole texts, of which
the driver gets the places of kept features only. Scores cover all rows.

Defined cases: a null or empty text has one sentence without features; a null label is no label;
a document labelled twice counts as toxic if any row says so; without labels of both kinds every
score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchline.llm.common import by_bytes, remainder, saved, segments, spread
from batchline.llm.words import SENTENCE_END, STOP, words_of

TRAIN = 20_000
FEATURES = 4096
#: Documents of the training rows that must have a feature.
LEAST = 4
#: Score from which a document is toxic, and from which a sentence is pointed out.
THRESHOLD = 0.5
AT_ONCE = 2 << 20


def features_of(word: str) -> tuple[str, ...]:
    """The word and its beginnings; ``^`` marks a beginning."""
    return (word, *(f"^{word[:n]}" for n in range(4, 9) if len(word) > n))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Bags:
    """Sentences' features of a batch: pairs (sentence, feature), and each document's sentences."""

    sentence: np.ndarray
    feature: np.ndarray
    edges: np.ndarray  # first sentence of each document, and the end

    def sentence_scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        z = np.bincount(self.sentence, weights[self.feature], minlength=self.edges[-1])
        return z + bias


def bags(texts: pa.Array, known: dict[str, int]) -> Bags:
    """Sentences and the known features in them. A sentence is what lies between two ends, so the
    n-th end of a text begins sentence n."""
    words = words_of(texts, sentences=True)
    found = [[known[f] for f in features_of(w) if f in known] if w != STOP else [] for w in words.distinct]
    stop = words.distinct.index(STOP) if STOP in words.distinct else -1
    stops = words.code == stop
    upto = segments(stops)
    owner = words.owner
    edges = segments(np.diff(upto[words.edges]) + 1)
    sentence = upto[:-1] - upto[words.edges[:-1]][owner] + edges[:-1][owner]
    n = np.array([len(f) for f in found], np.int64)
    flat = np.array([x for f in found for x in f], np.int64)
    held = n[words.code] if len(words.code) else np.zeros(0, np.int64)
    at = np.flatnonzero(held)
    code = words.code[at]
    begin = segments(n)[:-1]
    places = spread(begin[code], n[code])
    return Bags(np.repeat(sentence[at], held[at]), flat[places], edges)


@dataclass
class Model:
    """Weights of the features, and the logit of a sentence that has none of them."""

    known: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document scores, sentence probabilities, first sentence of each document."""
        held = bags(texts, self.known)
        if not np.isfinite(self.bias):
            return np.zeros(len(texts)), np.zeros(held.edges[-1]), held.edges
        z = held.sentence_scores(self.weights, self.bias)
        clear = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, z))])  # -log of no offence so far
        return -np.expm1(-(clear[held.edges[1:]] - clear[held.edges[:-1]])), _sigmoid(z), held.edges


def fit(bag: Bags, toxic: np.ndarray, features: int, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Maximum likelihood through the noisy-or by full gradients with adaptive steps."""
    weights, bias = np.zeros(features), -10.0
    docs = np.repeat(np.arange(len(toxic)), np.diff(bag.edges))
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    share = 0.5 * share + 0.5 / len(toxic)  # between equal classes and equal documents
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        z = bag.sentence_scores(weights, bias)
        p = _sigmoid(z)
        clear = np.bincount(docs, np.logaddexp(0, z), minlength=len(toxic))
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        pull = np.where(toxic, -1 / np.maximum(np.expm1(np.minimum(clear, 50)), 1e-9), 1.0)
        slope = p * (share * pull)[docs]
        gradient = np.append(np.bincount(bag.feature, slope[bag.sentence], minlength=features) + ridge * weights, slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, float(bias)


# --- Spark ----------------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    """``text, toxic`` of labelled documents that are not held out, ``most`` at most, by hash; of
    rows that share a ``doc_id`` the one with the least text."""
    told = (
        labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(remainder(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    some = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # ``most`` rows of two numbers: small enough to send to the texts
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that have a feature, per run of texts."""
    for whole in batches:
        for batch in by_bytes(whole, "text", AT_ONCE):
            words = words_of(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            of_word = [features_of(w) for w in words.distinct]
            seen = {True: Counter(), False: Counter()}
            for i, kind in enumerate(toxic.tolist()):
                own = set(words.code[words.edges[i] : words.edges[i + 1]].tolist())
                seen[kind].update({f for c in own for f in of_word[c]})
            names = list(seen[True].keys() | seen[False].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (True, False))],
                ["feature", "toxic", "clean"],
            )


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN, features: int = FEATURES) -> Model:
    rows = saved(training_rows(docs, labels, most), "toxic-training")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model()
    counted = rows.mapInArrow(_frequencies, "feature string, toxic long, clean long")
    both = counted.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).filter(F.col("a") + F.col("b") >= LEAST)
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), n0 + n1
    chi = F.pow(a * (n0 - b) - b * (n1 - a), 2) * n / ((a + b) * (n - a - b + 1) * n0 * n1)
    best = both.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(features).collect()
    known = {r["feature"]: i for i, r in enumerate(best)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", AT_ONCE):
                held = bags(batch.column("text"), known)
                doc = np.searchsorted(held.edges, held.sentence, side="right") - 1
                local = held.sentence - held.edges[doc]
                cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                parts = [np.stack([local[x:y], held.feature[x:y]], axis=1).astype("<i4").tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").cast(pa.int32()), pa.array(np.diff(held.edges)), pa.array(parts, pa.binary())],
                    ["toxic", "sentences", "pairs"],
                )

    sample = rows.mapInArrow(gather, "toxic int, sentences long, pairs binary")
    kept = sample.orderBy("toxic", "sentences", "pairs").collect()  # at most ``most`` rows
    edges = segments(np.array([r["sentences"] for r in kept]))
    pairs = [np.frombuffer(r["pairs"], "<i4").reshape(-1, 2).astype(np.int64) for r in kept]
    sentence = np.concatenate([p[:, 0] + at for p, at in zip(pairs, edges, strict=False)])
    bag = Bags(sentence, np.concatenate([p[:, 1] for p in pairs]), edges)
    weights, bias = fit(bag, np.array([r["toxic"] == 1 for r in kept]), len(known))
    return Model(known, weights, bias)


def scored(docs: DataFrame, model: Model, places: bool = False) -> DataFrame:
    """All columns of ``docs`` (but of these names) and ``score``; with ``places`` also ``offences``: begin, end (in
    characters) and score of each sentence from the threshold on."""

    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", AT_ONCE):
                score, p, edges = model.score(batch.column("text"))
                out = {"doc": batch.column("doc"), "score": pa.array(score)}
                if places:
                    texts = batch.column("text").to_pylist()
                    out["offences"] = pa.array([_places(t, p[a:b]) for t, a, b in zip(texts, edges, edges[1:], strict=False)], kind)
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    own = [c for c in docs.columns if c not in ("score", "offences")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("doc"), F.col("text"))
    added = {"score": "double"} | ({"offences": "array<struct<begin:int,end:int,score:double>>"} if places else {})
    schema = ", ".join([f"doc {rows.schema['doc'].dataType.simpleString()}", *(f"{k} {v}" for k, v in added.items())])
    return rows.mapInArrow(run, schema).select("doc.*", *added)


def _places(text: str | None, p: np.ndarray) -> list[dict]:
    if not (p >= THRESHOLD).any():
        return []
    text = text or ""
    ends = [(m.start(), m.end()) for m in re.finditer(SENTENCE_END, text)]
    begins, stops = [0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)]
    return [{"begin": begins[i], "end": stops[i], "score": float(p[i])} for i in np.flatnonzero(p >= THRESHOLD).tolist()]


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document and ``offences``, the places of the
    sentences that are themselves at the threshold or above (none in most documents)."""
    model = train(docs, labels)
    out = scored(docs.select("doc_id", "text"), model, places=True)
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offences",
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return scored(rows, train(docs, labels)).filter(F.col("score") < THRESHOLD).select("row.*")
