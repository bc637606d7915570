"""All visits of the persons behind given visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitbook.session import settle


def history_of(visits: DataFrame, key: int, id: str = "id", name: str = "name") -> DataFrame:
    """Every visit with exactly the name of visit `key`; empty for an unknown id."""
    person = visits.where(F.col(id) == key).agg(F.min(name)).scalar()
    return visits.where(F.col(name) == person)


def visit_history(visits: DataFrame, ids: DataFrame, id: str = "id", name: str = "name") -> DataFrame:
    """Every visit of every person behind the listed visits, once, with n_visits of the person.

    Names are counted first, per task before the shuffle, and the wanted ones are written to
    the shared folder. The join then reads one row per name from there and takes the visits
    from an exchange of their own, which adaptive execution may split where a name is very
    frequent.
    """
    persons = visits.join(ids.select(id).distinct(), id, "left_semi").select(name).distinct()
    counts = settle(history_counts(visits, name).join(persons, name, "left_semi"), visits.sparkSession, "persons")
    return visits.join(counts, name)


def history_counts(visits: DataFrame, name: str = "name") -> DataFrame:
    """(name, n_visits), summed per task before the shuffle."""
    return visits.groupBy(name).agg(F.count(F.lit(1)).alias("n_visits"))
