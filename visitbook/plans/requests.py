"""The requests a clinic makes: statistics, listing, billing and intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from visitbook.functions.labels import age_label, day_label, timestamp_label, unit_label
from visitbook.functions.text import ellipsis
from visitbook.operators.access import display_labels, project_for_role, visible_columns
from visitbook.operators.distribution import top_names
from visitbook.operators.ingest import accepted, check_inserts, rejected, to_rows
from visitbook.operators.invoice import (
    accepted_invoices,
    check_invoices,
    invoice_lines,
    keep_valid_articles,
    price,
    rejected_invoices,
    with_totals,
)
from visitbook.operators.search import latest, search
from visitbook.operators.series import daily_visits, monthly_visits, with_revenue
from visitbook.schemas import PAGE_SIZE, PATIENTS, UNITS


def statistics(visits: DataFrame) -> dict[str, DataFrame]:
    """Daily and monthly revenue and the most frequent names."""
    return {
        "daily_revenue": with_revenue(daily_visits(visits)),
        "monthly_revenue": with_revenue(monthly_visits(visits)),
        "top_names": top_names(visits),
    }


def shown(df: DataFrame, name: str) -> Column:
    """A stored column as the listing shows it."""
    c, dtype = F.col(name), df.schema[name].dataType
    if name == "age":
        text = age_label(c, F.col("age_years"), F.col("age_months"), F.col("age_days"))
    elif name in UNITS:
        text = unit_label(c, UNITS[name])
    elif isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        text = day_label(c) if name == "date_of_birth" else timestamp_label(c.cast(
            "timestamp" if isinstance(dtype, DateType) else dtype))
    else:
        text = c.cast("string")
    return ellipsis(text).alias(name)


def listing(visits: DataFrame, query: str, role: str, size: object = PAGE_SIZE) -> DataFrame:
    """Search, newest first, only the columns of the role, formatted and labelled.

    The limit comes before the formatting and the role decides what the scan reads.
    """
    found = latest(search(visits, query), size)
    text = found.select("id", *[shown(found, c) for c in visible_columns(role)])
    return display_labels(project_for_role(text, role))


def billing(invoices: DataFrame) -> dict[str, DataFrame]:
    """Priced lines, totals and refused documents."""
    checked = check_invoices(invoices, form=True)
    priced = price(keep_valid_articles(accepted_invoices(checked)))
    return {
        "lines": invoice_lines(priced, "invoice_id"),
        "totals": with_totals(priced).select("invoice_id", "meta", "patient_percent", "subtotals", "total"),
        "rejected": rejected_invoices(checked),
    }


def intake(requests: DataFrame, received_at: Column | None = None) -> dict[str, DataFrame]:
    """New visits as typed rows, and refused requests with their errors."""
    checked = check_inserts(requests, received_at)
    return {"accepted": to_rows(accepted(checked)), "rejected": rejected(checked)}


def conform(visits: DataFrame) -> DataFrame:
    """A table that holds some of the visit columns, completed with nulls."""
    missing = [f for f in PATIENTS if f.name not in visits.columns]
    return visits.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
