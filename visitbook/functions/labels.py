"""Display formatting: dates, amounts, ages, units, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitbook.functions.text import default_text

# French month names, January first.
MONTHS = [
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre",
]


def timestamp_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def french_day_label(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def french_minute_label(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy HH:mm")


def french_month_label(c: Column) -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(c))
    return F.concat_ws(" ", month, F.date_format(c, "yyyy"))


def plain_number(c: Column) -> Column:
    """A number without exponent and without a trailing '.0'."""
    digits = c.cast("string").try_cast("decimal(38,18)").cast("string")
    return F.coalesce(F.regexp_replace(digits, r"\.?0+$", ""), c.cast("string"))


def unit_label(c: Column, unit: str) -> Column:
    """'70 kg'. Missing and zero values show as empty."""
    shown = F.concat(plain_number(c), F.lit(f" {unit}"))
    return F.when(c.isNotNull() & (c != 0), shown).otherwise(F.lit(""))


def age_label(age: Column, years: Column, months: Column, days: Column) -> Column:
    """'1 ans 6 mois 10 jours', without zero or missing parts; empty without an age."""
    parts = [
        F.when(part != 0, F.concat(part.cast("int").cast("string"), F.lit(f" {word}")))
        for part, word in ((years, "ans"), (months, "mois"), (days, "jours"))
    ]
    return F.when(age.isNotNull() & (age != 0), F.concat_ws(" ", *parts)).otherwise(F.lit(""))


def fixed1(c: Column) -> Column:
    """One decimal, rounded from the exact binary value, ties away from zero.

    20*v is formed as 16*v - k + 4*v, each step exact, so a value that only prints
    like a tie (0.35) still goes to the side it is really on.
    """
    v = F.abs(c)
    k = F.rint(v * 20)
    beyond = (v * 16 - k) + v * 4
    tenths = F.when(k % 2 == 0, k / 2).when(beyond < 0, (k - 1) / 2).otherwise((k + 1) / 2).cast("bigint")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def bin_label(low: Column, high: Column) -> Column:
    return F.concat(fixed1(low), F.lit(" - "), fixed1(high))


def money_label(c: Column) -> Column:
    """Whole units, truncated; null for what no bigint can hold."""
    return F.concat(c.try_cast("bigint").cast("string"), F.lit(" Fcfa"))


def insurer_label(patient_percent: Column) -> Column:
    return F.concat((100 - patient_percent).try_cast("bigint").cast("string"), F.lit("%"))


def invoice_name(nom: Column, prenom: Column, at: Column) -> Column:
    return F.concat(
        F.lit("facture_"), nom, F.lit("_"), prenom, F.lit("_"),
        F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".pdf"),
    )


def log_line(user_type: Column, action: Column, details: Column) -> Column:
    return F.concat(
        F.lit("UserType: "), default_text(user_type, "unknown"),
        F.lit(" | Action: "), action,
        F.lit(" | Details: "), default_text(details, ""),
    )


def digest_header(day: Column) -> Column:
    return F.concat(F.lit("Action Logs Report for "), day_label(day))
