"""Words of a batch of texts as numbers: Arrow splits and codes, numpy does the rest.

A word is a run of letters and digits of the text in lower case. Sentences end at runs of
``. ! ?`` or a line break; with ``sentences=True`` each such run stands as the word ``.``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from batchline.llm.common import segments

STOP = "."
#: Python form of a sentence's end, for places in the text.
SENTENCE_END = r"[.!?\n]+"


@dataclass
class Words:
    """``distinct`` words; ``code`` of every word in order; ``edges`` of the texts in ``code``."""

    distinct: list[str]
    code: np.ndarray
    edges: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))


def words_of(texts: pa.Array, sentences: bool = False) -> Words:
    """Words of each text; a null text has none."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if sentences:
        low = pc.replace_substring_regex(low, SENTENCE_END, " . ")
    inner = r"[^\p{L}\p{N}.]+" if sentences else r"[^\p{L}\p{N}]+"
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(low, inner, " "))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    edges = segments(counts)
    if "" in distinct:  # what a blank at either end leaves
        real = code != distinct.index("")
        edges = segments(real)[edges]
        code = code[real]
    return Words(distinct, code, edges)
