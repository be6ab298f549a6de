"""Awkward documents: what every corpus operator has to take."""

from __future__ import annotations

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, "
          "digest string, row long, batch int, node long, size long, shard int, pos int, word string, "
          "score double, found string, text_sha256 string")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
TEXTS = [
    (5, "the quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (3, "the quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (3, "the quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (9, "der schnelle braune fuchs springt über den faulen hund am ufer des flusses", "de"),
    (10, "the  quick\tbrown fox jumps over the lazy dog near the river bank today", "en"),
    (11, "", "en"), (12, "", None), (13, None, "de"), (14, None, None),
    (None, "a text without a number", "en"), (None, None, None), (None, "", "en"),
    (15, "!!! ... ???", "en"), (16, "x", "de"), (17, LONG, "en"), (18, LONG + " tail", "en"),
    (19, "\x00\x00 odd   signs ﬀ 日本語 𝕏 é", "de"), (-4, "minus four", None),
]


def awkward(spark, texts=TEXTS):
    """The documents with further columns named like the operators' own."""
    rows = [(key, text, lang, None if i % 3 else "src0", None, True, "d", i, 1, 2, 3, 4, 5, "w", 0.5,
             "f", "h") for i, (key, text, lang) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id long, text string")
