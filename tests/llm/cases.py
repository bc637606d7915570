"""Rows that every corpus operator must survive, and helpers of the brute-force versions."""

from __future__ import annotations

import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text: str | None) -> str:
    """A-Z lower-cased, other letters as they are."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text))


def long_text(n: int = 60_000) -> str:
    return " ".join(f"word{i % 977} Ünïcode{i % 31}" for i in range(n))


def documents(spark, texts, langs=None):
    """A documents table of the given texts; ids count from 0."""
    rows = [(i, t, langs[i] if langs else "en", f"src{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT)


def awkward(spark):
    """Nulls in every column, empty texts, blanks, repeated rows, ties, a long text."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, same, "en", "a", 5), (1, same, "en", "a", 5), (2, same, "fr", None, None), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, " \n\t ", "de", "b", 4), (None, "no id here at all", "en", "c", 17), (6, "é", "fr", "c", 1),
        (7, long_text(), "en", "c", 9), (8, "!!! 123 ???", None, "c", 11), (9, "x" * 50_000, "en", "c", 50_000),
    ]
    return spark.createDataFrame(rows, DOCUMENT)


def empty(spark):
    return spark.createDataFrame([], DOCUMENT)
