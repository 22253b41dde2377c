"""Small tables with the awkward rows that every operator must bear."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, `key` string"

WORDS = "the red fox and a grey hen saw two old men walk by the slow river in warm rain while their small dog ran far ahead".split()


def prose(seed: int, n: int) -> str:
    """Deterministic words; different seeds share few shingles."""
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x % len(WORDS)] + (str(x % 13) if x % 3 == 0 else "") + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def awkward() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows; the last
    columns clash with names that operators use."""
    long = prose(1, 30_000)
    texts = [
        (1, None, None, None), (2, "", "en", "b"), (3, "   \n\t ", "en", "b"), (4, long, "en", "a"), (5, long, "en", "a"),
        (6, prose(2, 80), "en", None), (6, prose(2, 80), "en", None), (None, prose(3, 50), None, "a"), (8, "12 34 !!! ???", "de", "c"),
        (9, "a" * 50_000, "en", "a"), (10, prose(2, 80).replace(" ", "  "), "en", "b"), (11, "日本語 テキスト é É ﬁ <|endoftext|>", "xx", "c"),
        (12, "x", "en", "c"), (13, "x", "en", "c"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), 0.5, "n", None) for i, t, lang, source in texts]


def table(spark, rows: list[tuple] | None = None, schema: str = SCHEMA):
    """The rows as a table of three partitions."""
    return spark.createDataFrame(awkward() if rows is None else rows, schema).repartition(3)


def documents(spark, pairs):
    return spark.createDataFrame([(i, t) for i, t in pairs], "doc_id long, text string").repartition(3)
