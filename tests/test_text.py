from __future__ import annotations

import sys
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitbook.functions import text


def bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def apply(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, s string").select("i", f(F.col("s")).alias("r")).collect()
    return [r.r for r in sorted(out, key=lambda r: r.i)]


def test_strip_accents_known(spark):
    given_ = ["Élodie", "été", "plain", "", None, "각힣", "ঊো", "x\U0001d15ey", "Łódź", "ﬁ"]
    assert apply(spark, given_, text.strip_accents) == [None if v is None else bare(v) for v in given_]


def test_strip_accents_every_character(spark):
    """Each assigned character on its own, Hangul included."""
    chars = [chr(c) for c in range(1, 0x1E000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    lines = ["".join(f"{c}|" for c in chars[i:i + 50]) for i in range(0, len(chars), 50)]
    assert apply(spark, lines, text.strip_accents) == [bare(v) for v in lines]


def test_tables_cover_unicode():
    """The generated tables name every character they must, wherever it is."""
    changed, spaces = set(), set()
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isspace():
            spaces.add(c)
        if not 0xD800 <= cp < 0xE000 and cp not in text._HANGUL and bare(c) != c:
            changed.add(c)
    source, _, several = text._accent_tables()
    assert changed == set(source) | set(several)
    assert spaces == set(text._python_whitespace())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=40))
def test_text_functions_match_python(spark, values):
    assert apply(spark, values, text.strip_accents) == [bare(v) for v in values]
    assert apply(spark, values, text.strip_ws) == [v.strip() for v in values]


def test_strip_ws(spark):
    assert apply(spark, [" \t a b　\n", "\x1c x", ""], text.strip_ws) == ["a b", "x", ""]
    assert apply(spark, ["﻿a ", "\x1ca"], text.browser_trim) == ["a", "\x1ca"]


def test_title_case(spark):
    names = ["jean-paul", "elodie n'a", "o'neil", "ABC def", "ǆ ß3x", "", None]
    expected = [None if n is None else n.lower().title() for n in names]
    assert apply(spark, names, text.title_case) == expected
    assert expected[:2] == ["Jean-Paul", "Elodie N'A"]


def test_ellipsis(spark):
    assert apply(spark, ["a" * 30, "a" * 31, None, "é" * 31], text.ellipsis) == [
        "a" * 30, "a" * 30 + "...", "", "é" * 30 + "..."
    ]


def test_split_name(spark):
    values = ["A", "A B C", "", "  A B  "]
    assert apply(spark, values, lambda c: text.split_name(c)[0]) == ["A", "C", "", "B"]
    assert apply(spark, values, lambda c: text.split_name(c)[1]) == ["", "A B", "", "A"]


def test_display_user(one):
    row = one(
        "a string, b string", ("Dr_A_B", "x"),
        text.display_user(F.lit("infirmiers"), F.col("b")), text.display_user(F.lit("receptionistes"), F.col("b")),
        text.display_user(F.lit("medecins"), F.col("a")), text.default_text(F.lit(""), "N/A"),
        text.default_text(F.lit(None).cast("string"), "Aucune"),
    )
    assert tuple(row) == ("infirmier", "receptioniste", "Dr A B", "N/A", "Aucune")
