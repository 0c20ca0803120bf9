from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows, and columns named like results."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 10),
        (2, "", "en", "a", 0), (3, None, None, None, None), (None, "text without an id but with words in it", "en", "b", 5), (None, None, None, None, None),
        (4, LONG, "en", "b", len(LONG)), (5, "one", "de", "b", 3), (6, "   \n\t ", "de", None, 6),
        (7, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "c", 10), (1, "another text under a known id", "en", "c", 4), (8, "é😀 ünïcode wörds ñ", "fr", "c", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = {c: "lit" for c in ("shard", "slot", "size", "kept", "copy", "target", "words", "cls", "score", "x", "place", "n_words", "host_rate")}
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
