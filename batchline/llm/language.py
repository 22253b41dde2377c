"""Language identification with language-bitmask n-gram filters.

For each language the character n-grams (``GRAMS`` letters, word ends marked) that at least
``SHARE`` of its training documents hold go into a Bloom filter. The filters are bit-sliced: one
array has, at each position, a word with one bit per language, so the bitwise and of the words at
an n-gram's positions is the mask of all languages that contain it. A text is looked up n-gram by
n-gram; the bits are counted per language, each count c of n is corrected for the filter's false
positives f, (c - n f) / (1 - f), and the largest decides.

Training rows are, per language, the ``TRAIN`` ones with the least hash of ``doc_id`` (a
documented bound; all where there are fewer), whole texts. What the driver gets is the kept
n-grams: at most 1 / ``SHARE`` times the n-grams of a text, per language.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the first
language by code point; a language with no kept n-gram is never predicted; if nothing was learned
every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchline.llm.common import by_bytes, mixed, remainder, saved, segments
from batchline.llm.words import Words, words_of
from batchline.scratch import settings

TRAIN = 4000
#: Parts of a language, by hash, that are ranked apart before the language is.
PARTS = 64
GRAMS = (3, 4, 5)
SHARE = 0.05
HASHES = 4
#: Positions of the filters for each n-gram of the largest language.
ROOM = 16
AT_ONCE = 4 << 20
UNKNOWN = "und"


def grams_of(words: Words, sizes: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes of the distinct words, word after word, and the words' edges in them."""
    if not words.distinct:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    joined = " " + " ".join(words.distinct) + " "
    letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    blanks = np.flatnonzero(letters == 32)
    word = np.zeros(len(letters), np.int64)
    word[blanks[1:-1]] = 1
    word = np.cumsum(word)
    values, owners = [], []
    with np.errstate(over="ignore"):
        for size in sizes:
            if len(letters) < size:
                continue
            n = len(letters) - size + 1
            value = np.full(n, size, np.uint64)
            inner = np.zeros(n, bool)
            for k in range(size):
                value = value * np.uint64(0x100000001B3) + letters[k : k + n]
                if 0 < k < size - 1:
                    inner |= letters[k : k + n] == 32
            at = np.flatnonzero(~inner)
            # two blanks next to each other do not occur, so a gram has a letter and one owner
            values.append(mixed(value[at]))
            owners.append(word[at])
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words.distinct))
    return value[order], segments(counts)


@dataclass
class Filters:
    """Bit-sliced filters of ``languages``; 64 languages to a slice."""

    languages: list[str] = field(default_factory=list)
    slices: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.uint64))  # slices x positions
    false: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], hashes: int = HASHES, room: int = ROOM) -> Filters:
        names = sorted((x for x in grams if len(grams[x])), key=lambda x: [ord(c) for c in x])
        if not names:
            return cls()
        most = max(len(grams[x]) for x in names)
        size = 1 << int(np.ceil(np.log2(max(64, most * room))))
        slices = np.zeros((-(-len(names) // 64), size), np.uint64)
        for i, name in enumerate(names):
            for at in _positions(grams[name], size, hashes):
                slices[i // 64, at] |= np.uint64(1 << (i % 64))
        filled = np.array([np.count_nonzero(slices[i // 64] & np.uint64(1 << (i % 64))) for i in range(len(names))])
        return cls(names, slices, (filled / size) ** hashes)

    def masks(self, grams: np.ndarray, hashes: int = HASHES) -> np.ndarray:
        """Slices x grams: the languages that contain each n-gram."""
        out = np.full((len(self.slices), len(grams)), ~np.uint64(0))
        for at in _positions(grams, self.slices.shape[1], hashes):
            out &= self.slices[:, at]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words = words_of(texts)
        grams, edges = grams_of(words)
        masks = self.masks(grams)
        lettered = np.array([any(c.isalpha() for c in w) for w in words.distinct], bool)
        n_of_word = np.diff(edges)
        n = _per_text(n_of_word, words)
        known = _per_text(lettered, words) > 0
        rates = np.zeros((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            bit = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            upto = segments(bit)
            count = _per_text(upto[edges[1:]] - upto[edges[:-1]], words)
            rates[i] = np.maximum(0, (count - n * self.false[i]) / (1 - self.false[i])) / np.maximum(1, n)
        if not len(self.languages):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = rates.argmax(axis=0)
        score = rates.max(axis=0) / np.maximum(rates.sum(axis=0), 1e-12)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, np.clip(score, 0, 1), 0.0)


def _positions(grams: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
    for k in range(hashes):
        yield (mixed(grams ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) & np.uint64(size - 1)).astype(np.int64)


def _per_text(of_word: np.ndarray, words: Words) -> np.ndarray:
    upto = segments(of_word[words.code]) if len(words.code) else np.zeros(1, np.int64)
    return upto[words.edges[1:]] - upto[words.edges[:-1]]


# --- Spark ----------------------------------------------------------------------------------------


def training_rows(docs: DataFrame, most: int = TRAIN) -> DataFrame:
    """``text, lang`` of rows that are not held out, at most ``most`` of a language, by hash; of
    rows that share ``doc_id`` and language the one with the least text."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(remainder(F.col("doc_id"), 3) != 1)
    names = known.select("doc_id", "lang").filter("doc_id IS NOT NULL").distinct().withColumn("at", F.xxhash64("doc_id"))
    # first within parts of a language, then among what is left of its parts
    for part in (["lang", F.pmod("at", F.lit(PARTS))], ["lang"]):
        order = Window.partitionBy(*part).orderBy("at", "doc_id")
        names = names.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")
    # stored, its size is known: a few ids go to the texts, not the texts to the ids
    chosen = saved(names.select("doc_id", "lang"), "language-chosen")
    rows = known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold an n-gram, by language, per run of texts."""
    for whole in batches:
        for batch in by_bytes(whole, "text", AT_ONCE):
            words = words_of(batch.column("text"))
            grams, edges = grams_of(words)
            distinct, of_gram = np.unique(grams, return_inverse=True)
            coded = batch.column("lang").dictionary_encode()
            lang_of = coded.indices.to_numpy(zero_copy_only=False)
            total = np.zeros((len(coded.dictionary), len(distinct)), np.int64)
            for i in range(batch.num_rows):
                own = np.unique(words.code[words.edges[i] : words.edges[i + 1]])
                held = np.zeros(len(distinct), bool)
                n = edges[own + 1] - edges[own]
                at = np.arange(n.sum()) + np.repeat(edges[own] - segments(n)[:-1], n)
                held[of_gram[at]] = True
                total[lang_of[i]] += held
            for k, name in enumerate(coded.dictionary.to_pylist()):
                some = np.flatnonzero(total[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.string()), pa.array(distinct[some].view(np.int64)), pa.array(total[k][some])], ["lang", "gram", "n"]
                )


def train(docs: DataFrame, most: int = TRAIN, share: float = SHARE) -> Filters:
    # Spark applies a rank limit before the shuffle only up to a threshold, 1000 if nothing is said
    with settings(docs.sparkSession, spark__sql__optimizer__windowGroupLimitThreshold=str(max(most, 1000))):
        rows = saved(training_rows(docs, most), "language-training")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    counted = rows.mapInArrow(_frequencies, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = counted.join(sizes, "lang").filter((F.col("n") >= share * F.col("docs"))).select("lang", "gram")
    found = kept.groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams")).collect()
    return Filters.build({r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in found})


def predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", AT_ONCE):
                names, score = filters.predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    out = predicted(docs, train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
