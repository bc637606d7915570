"""Parsing and arithmetic on single fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitbook.functions.text import strip_ws

# What counts as a number or an integer in submitted text: digits may be grouped
# by single underscores, and nan and inf are numbers.
_DIGITS = r"\d(?:_?\d)*"
INTEGER_PATTERN = rf"^[+-]?{_DIGITS}$"
NUMBER_PATTERN = (
    rf"(?i)^[+-]?(?:inf|infinity|nan|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)$"
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _parse(c: Column, plain: str, pattern: str, as_type: str) -> Column:
    """Values in plain notation are read directly; others are checked against the full pattern."""
    text = strip_ws(c)
    careful = F.when(text.rlike(pattern), F.replace(text, F.lit("_"), F.lit("")).try_cast(as_type))
    return F.when(c.rlike(plain), c.try_cast(as_type)).otherwise(careful)


def parse_float(c: Column) -> Column:
    """Number in text; null when blank or not a number (see `not_parsed`)."""
    return _parse(c, r"^-?\d+(?:\.\d+)?$", NUMBER_PATTERN, "double")


def parse_int(c: Column) -> Column:
    """Integer in text; '12.5' is not one."""
    return _parse(c, r"^-?\d+$", INTEGER_PATTERN, "int")


def not_parsed(c: Column, parsed: Column) -> Column:
    """True where a value was supplied and could not be read."""
    return blank_to_null(c).isNotNull() & parsed.isNull()


def age_part(c: Column) -> Column:
    """Years, months or days: blank counts as 0, anything but an integer is null."""
    return F.when(c == "", F.lit(0)).otherwise(parse_int(c))


def age_in_years(years: Column, months: Column, days: Column) -> Column:
    return F.bround(years + months / 12 + days / 365, 10)


def age_parts(age: Column) -> tuple[Column, Column, Column]:
    """Whole years, months and 30-day days of a fractional age."""
    years = F.floor(age)
    months_exact = (age - years) * 12
    months = F.floor(months_exact)
    return years, months, F.floor((months_exact - months) * 30)


def spaced_int(c: Column) -> Column:
    """'10 000' -> 10000."""
    return F.replace(c, F.lit(" "), F.lit("")).try_cast("bigint")


def is_finite(c: Column) -> Column:
    """Neither NaN nor infinite; null for null."""
    return F.abs(c) < F.lit(float("inf"))


def round_half_even(c: Column) -> Column:
    """Nearest integer, ties to the even neighbour; null where no bigint is near."""
    return F.rint(c).try_cast("bigint")


def to_day(c: Column) -> Column:
    return F.to_date(c)


def to_month(c: Column) -> Column:
    return F.trunc(c, "MM")


def clinic_day(instant: Column, tz: str) -> Column:
    """Calendar day of an instant in the clinic's time zone."""
    return F.to_date(F.convert_timezone(None, F.lit(tz), instant))
