"""Who may see which columns and edit which rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitbook.functions.text import display_name
from visitbook.schemas import LABELS, NURSES, RECEPTIONISTS, ROLE_COLUMNS


def visible_columns(role: str) -> list[str]:
    """Columns of a role, in display order; an unknown role sees none."""
    return ROLE_COLUMNS.get(role, [])


def project_for_role(df: DataFrame, role: str) -> DataFrame:
    return df.select(*visible_columns(role))


def display_labels(df: DataFrame) -> DataFrame:
    """Columns under their French label; a column without one keeps its name."""
    return df.select(*[F.col(c).alias(LABELS.get(c, c)) for c in df.columns])


def can_edit(role: Column, username: Column, signature: Column, lead: str) -> Column:
    """Whether a user may edit a row, by its signature.

    Nurses and receptionists edit everything, as does the lead physician; others edit
    unsigned rows and their own. An empty signature is not a missing one.
    """
    return (
        F.when(role.isin(NURSES, RECEPTIONISTS), F.lit(True))
        .when(signature.isNull(), F.lit(True))
        .when(username == lead, F.lit(True))
        .otherwise(F.coalesce((signature != "") & (signature == display_name(username)), F.lit(False)))
    )


def editable_by(df: DataFrame, role: Column, username: Column, lead: str, signature: str = "signature") -> DataFrame:
    """Adds can_edit. Role and user may be literals or columns of a joined user table."""
    return df.withColumn("can_edit", can_edit(role, username, F.col(signature), lead))
