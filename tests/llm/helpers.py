"""Fixtures shared by the tests of the llm operators."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h long, kept_id long, toxic string, grade string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, lang="en", source="a", start=0):
    """documents with two more columns whose names the operators also use inside."""
    rows = [(start + i, t, lang, source, len(t or ""), "x", 1, 7, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 701}" for i in range(60_000))
    rows = [
        (None, None, None, None, None, None, None),
        (None, "a b c", None, None, 5, None, None),
        (1, "", "en", "a", 0, "", 0),
        (1, "", "en", "a", 0, "", 0),
        (2, None, "en", "a", None, None, None),
        (3, "one two three four\nfive  six\tseven", "en", "a", 30, "x", 1),
        (3, "one two three four\nfive  six\tseven", "en", "a", 30, "x", 1),
        (3, "another text under the same id", "de", None, 30, "x", 1),
        (4, long, "en", "b", len(long), "x", 1),
        (5, "x" * 20_000, "fr", "b", 20_000, "x", 1),
        (6, " \n\t\r\x0b\x0c ", "fr", "c", 7, "x", 1),
        (7, "Ünïcödé İ Σ   \U0001f600 é", "fr", "c", 20, "x", 1),
    ]
    return spark.createDataFrame([(*r, None, "y", None) for r in rows], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
