"""Text functions. Everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitbook.schemas import NURSES, RECEPTIONISTS

_HANGUL = range(0xAC00, 0xD7A4)
# Planes that hold characters which decompose or are marks; the rest is unassigned or private.
_CODE_POINTS = (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200))
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{IsTitlecase}"

# What a browser's trim() removes.
BROWSER_WHITESPACE = (
    "\t\n\v\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


@lru_cache(maxsize=None)
def _python_whitespace() -> str:
    return "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def strip_ws(c: Column) -> Column:
    """Remove every kind of whitespace from both ends, not only spaces."""
    return F.btrim(c, F.lit(_python_whitespace()))


def browser_trim(c: Column) -> Column:
    """Trim with the browser's notion of whitespace (form fields)."""
    return F.btrim(c, F.lit(BROWSER_WHITESPACE))


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@lru_cache(maxsize=None)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """Source and target strings for translate(), and the characters that become several."""
    single, removed, several = {}, [], {}
    for cp in _CODE_POINTS:
        if cp in _HANGUL:
            continue
        c = chr(cp)
        bare = _bare(c)
        if bare == c:
            continue
        if not bare:
            removed.append(c)
        elif len(bare) == 1:
            single[c] = bare
        else:
            several[c] = bare
    # translate() deletes source characters that have no counterpart in the target.
    return "".join(single) + "".join(removed), "".join(single.values()), several


def _jamo(base: int, n: int) -> Column:
    return F.array(*[F.lit(chr(base + i)) for i in range(n)])


def _decompose_char(c: Column) -> Column:
    """One character whose decomposition has several base characters."""
    several = _accent_tables()[2]
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    s = F.ascii(c) - F.lit(_HANGUL.start)
    hangul = F.concat(
        F.get(_jamo(0x1100, 19), F.floor(s / 588).cast("int")),
        F.get(_jamo(0x1161, 21), F.floor((s % 588) / 28).cast("int")),
        F.when(s % 28 == 0, F.lit("")).otherwise(F.get(_jamo(0x11A7, 28), (s % 28).cast("int"))),
    )
    return F.when(s.between(0, len(_HANGUL) - 1), hangul).otherwise(F.coalesce(table[c], c))


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without the non-spacing marks.

    ASCII text is passed through, other text goes through one generated translate()
    table, and only text that holds characters decomposing into several base
    characters (Hangul syllables and a few Indic and musical signs) is split.
    """
    source, target, several = _accent_tables()
    translated = F.translate(c, source, target)
    split = F.array_join(F.transform(F.split(translated, ""), _decompose_char), "")
    hangul = f"{chr(_HANGUL.start)}-{chr(_HANGUL.stop - 1)}"
    low, high = [[x for x in several if (ord(x) > 0xFFFF) == astral] for astral in (False, True)]
    # Few ranges are quick to search for; the exact set is tried where they match.
    coarse = f"[{hangul}{min(low)}-{max(low)}{min(high)}-{max(high)}]"
    exact = f"[{hangul}{''.join(several)}]"
    return (
        F.when(F.octet_length(c) == F.char_length(c), c)
        .when(c.rlike(coarse) & c.rlike(exact), split)
        .otherwise(translated)
    )


def fold_name(c: Column) -> Column:
    """The form under which two spellings of a name count as one."""
    return F.lower(strip_accents(strip_ws(c)))


def title_case(c: Column) -> Column:
    """Capital after every character that is not a cased letter: jean-paul -> Jean-Paul."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"[{_CASED}]+|[^{_CASED}]+"), F.lit(0))
    capital = F.transform(runs, lambda w: F.concat(F.initcap(F.left(w, F.lit(1))), F.substring(w, 2, 2**31 - 1)))
    return F.array_join(capital, "")


def ellipsis(c: Column, width: int = 30) -> Column:
    """Text longer than `width` characters is shortened and marked; null shows as empty."""
    return F.coalesce(
        F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c),
        F.lit(""),
    )


def split_name(c: Column) -> tuple[Column, Column]:
    """(nom, prenom): the last word, and everything before it."""
    words = F.split(browser_trim(c), " ")
    nom = F.element_at(words, -1)
    prenom = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    return nom, prenom


def display_name(username: Column) -> Column:
    """User names are stored with underscores for spaces."""
    return F.replace(username, F.lit("_"), F.lit(" "))


def display_user(role: Column, username: Column) -> Column:
    """Shared accounts show their role in the singular, others the person's name."""
    singular = F.substring(role, F.lit(1), F.char_length(role) - 1)
    return F.when(role.isin(RECEPTIONISTS, NURSES), singular).otherwise(display_name(username))


def default_text(c: Column, default: str) -> Column:
    """Null or empty text shows as `default`."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
