"""Ids of whole texts by a public tokenizer, a batch of texts at a time.

The tokenizer never joins across ASCII white space, so a text's ids are the ids of its words
one after the other. A batch is split into words by Arrow, its distinct words are encoded once,
and the ids are gathered by word. Plain texts (ASCII and Latin letters, digits, marks) are
lowered and cut by Arrow as the tokenizer cuts them, so that "The", "the" and "the," share one
entry; in other texts the cut is made word by word, and words that are not plain go through the
whole tokenizer. Per worker at most ``REMEMBERED`` words are kept (about 50 MB) unless the caller has
room for more, after which the memory starts anew; results don't depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from batchline.llm.common import by_bytes, segments, spread

REMEMBERED = 200_000
#: Bytes of text that are encoded at a time.
AT_ONCE = 4 << 20
#: The id that ends a document.
END = 1

_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]*")
_PLAIN_TEXT = r"^[\t-\r -&(-;=-~À-ÖØ-öø-įı-ɏ]*$"  # without ' and <, which begin longer parts
_MARKS = r"([0-9]|[^\s0-9a-zß-öø-ɏ]+)"
# the cut of this tokenizer's vocabulary file, for plain words in lower case
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^a-z0-9À-ÖØ-öø-ɏ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    signs, spare = {}, 256
    for byte in range(256):
        if byte in printable:
            signs[byte] = chr(byte)
        else:
            signs[byte] = chr(spare)
            spare += 1
    return signs


class Encoder:
    """Ids of texts; one per worker and vocabulary file."""

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = tuple(self.tokenizer.get_added_tokens_decoder()[i].content for i in self.tokenizer.get_added_tokens_decoder())
        self.signs = {chr(k): v for k, v in _byte_signs().items()}
        self._forget()

    def _forget(self) -> None:
        self.parts: dict[str, list[int]] = {}
        self.places: dict[str, int] = {}
        self.starts = np.zeros(1 << 12, np.int32)
        self.lengths = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _part(self, part: str) -> list[int]:
        text = part if part.isascii() else "".join(self.signs[c] for c in part.encode().decode("latin-1"))
        return [token.id for token in self.model.tokenize(text)]

    def _word(self, word: str) -> list[int]:
        if not _PLAIN.fullmatch(word) or any(x in word for x in self.special):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        ids: list[int] = []
        for part in _CUT.findall(word.lower()):
            if part not in self.parts:
                self.parts[part] = self._part(part)
            ids += self.parts[part]
        if len(self.parts) > REMEMBERED // 10:
            self.parts = {}
        return ids

    def _learn(self, words: list[str]) -> None:
        """Encode words that the memory lacks and append them to it."""
        ids: list[int] = []
        tokenize, lengths, before = self.model.tokenize, [], 0
        for word in words:
            if word.isascii() and word.isalpha() and word.islower():
                ids += [token.id for token in tokenize(word)]
            else:
                ids += self._word(word)
            lengths.append(len(ids) - before)
            before = len(ids)
        first = len(self.places)
        self.places.update(zip(words, range(first, first + len(words)), strict=True))
        n = len(self.places)
        while len(self.starts) < n:
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.lengths[first:n] = lengths
        self.starts[first:n] = self.used + segments(np.asarray(lengths, np.int64))[:-1]
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For every word its place in the memory, and the number of words of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.match_substring_regex(texts, _PLAIN_TEXT)
        cut = pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), _MARKS, r" \1 ")
        split = pc.ascii_split_whitespace(pc.replace_with_mask(texts, plain, cut))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.places) + len(words) > (self.remembered or REMEMBERED):
            self._forget()
        self._learn([w for w in words if w not in self.places])
        of_word = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        return of_word[coded.indices.to_numpy(zero_copy_only=False)], counts

    def lengths_of(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, without an end id."""
        places, counts = self._places(texts)
        upto = segments(self.lengths[places])
        edges = segments(counts)
        return upto[edges[1:]] - upto[edges[:-1]]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the edges of the texts in it; ``end`` closes each text."""
        places, counts = self._places(texts)
        lengths = self.lengths[places]
        ids = self.ids[spread(self.starts[places], lengths)]
        edges = segments(lengths)[segments(counts)]
        if end is None:
            return ids, edges
        closed = edges + np.arange(len(edges))
        out = np.full(closed[-1], end, np.uint32)
        body = np.ones(len(out), bool)
        body[closed[1:] - 1] = False
        out[body] = ids
        return out, closed


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, remembered: int | None = None) -> Encoder:
    key = path, remembered
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def over_texts(
    path: str, work: Callable[[Encoder, pa.RecordBatch], Iterator[pa.RecordBatch]], text: str = "text", remembered: int | None = None
):
    """A function for ``mapInArrow`` that does ``work`` for runs of bounded bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, remembered)
        for batch in batches:
            for part in by_bytes(batch, text, AT_ONCE):
                yield from work(own, part)

    return run
