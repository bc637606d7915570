"""Cleaning and checking submitted visits before they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType

from visitbook.columns import compute_once, present
from visitbook.functions.fields import (
    age_in_years,
    age_part,
    clinic_day,
    not_parsed,
    parse_float,
    parse_int,
)
from visitbook.functions.text import display_name
from visitbook.schemas import (
    AGE_PARTS,
    CLINIC_TIME_ZONE,
    INSERT_BLANK_TO_NULL,
    INSERT_NUMERIC,
    PHYSICIANS,
    UPDATE_BLANK_TO_NULL,
    WRITABLE,
)

DATE_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"


def typed(text: Column, name: str) -> Column:
    """A submitted text as the type of the stored column; null if it cannot be read."""
    dtype = WRITABLE[name]
    if isinstance(dtype, DoubleType):
        return parse_float(text)
    if isinstance(dtype, IntegerType):
        return parse_int(text)
    if isinstance(dtype, DateType):
        return F.when(text.rlike(DATE_PATTERN), text.try_cast("date"))
    return text


def _type_errors(fields: Column, columns: list[str]) -> list[Column]:
    kinds = {DoubleType: "a number", IntegerType: "an integer", DateType: "a date"}
    errors = []
    for name in columns:
        kind = kinds.get(type(WRITABLE[name]))
        if kind:
            text = fields[name]
            errors.append(F.when(not_parsed(text, typed(text, name)), F.lit(f"{name} must be {kind}")))
    return errors


def _common_errors(fields: Column) -> list[Column]:
    unknown = F.exists(F.map_keys(fields), lambda k: ~k.isin(*WRITABLE))
    return [
        F.when(F.nullif(fields["name"], F.lit("")).isNull(), F.lit("name is required")),
        F.when(unknown, F.lit("unknown column")),
    ]


def _clear_blanks(fields: Column, columns: list[str]) -> Column:
    return F.transform_values(fields, lambda k, v: F.when((v == "") & k.isin(*columns), F.lit(None)).otherwise(v))


def _stamp(fields: Column, values: dict[str, Column]) -> Column:
    """Set keys that the system supplies, whatever the request says about them."""
    keys = F.array(*[F.lit(k) for k in values])
    stamps = F.map_from_arrays(keys, F.array(*[v.cast("string") for v in values.values()]))
    return F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*values)), stamps)


def _sign(fields: Column, role: Column, username: Column) -> Column:
    """Physicians sign what they write."""
    signed = _stamp(fields, {"signature": F.coalesce(display_name(username), F.lit(PHYSICIANS))})
    return F.when(role == PHYSICIANS, signed).otherwise(fields)


def _raw_fields() -> Column:
    return F.coalesce(F.col("fields"), F.create_map().cast("map<string,string>"))


def insert_columns(received_at: Column | None = None, tz: str = CLINIC_TIME_ZONE) -> tuple[Column, Column]:
    """(cleaned fields, errors) of a request for a new visit."""
    raw = _raw_fields()
    parts = {p: age_part(raw[p]) for p in AGE_PARTS}
    errors = _common_errors(raw)
    errors += [F.when(v.isNull(), F.lit(f"{p} must be an integer")) for p, v in parts.items()]
    errors += _type_errors(raw, [c for c in WRITABLE if c not in AGE_PARTS and c not in ("age", "created_at")])

    numeric = [c for c in INSERT_NUMERIC if c not in AGE_PARTS]
    stamps = {
        **parts,
        "age": age_in_years(*parts.values()),
        "created_at": clinic_day(F.current_timestamp() if received_at is None else received_at, tz),
    }
    cleaned = _stamp(_clear_blanks(raw, INSERT_BLANK_TO_NULL + numeric), stamps)
    return _sign(cleaned, F.col("role"), F.col("username")), present(errors)


def update_columns() -> tuple[Column, Column]:
    """(cleaned fields, errors) of a request for a partial update."""
    raw = _raw_fields()
    errors = _common_errors(raw) + _type_errors(raw, list(WRITABLE))
    cleaned = _clear_blanks(_sign(raw, F.col("role"), F.col("username")), UPDATE_BLANK_TO_NULL)
    return cleaned, present(errors)


def check_inserts(
    requests: DataFrame, received_at: Column | None = None, tz: str = CLINIC_TIME_ZONE
) -> DataFrame:
    """Cleaned `fields` and an `errors` array for new visits; a request without errors is accepted.

    Requests carry role, username and fields, a map from column to submitted text.
    `received_at` is the instant of the request, by default the time of the query.
    """
    fields, errors = insert_columns(received_at, tz)
    return compute_once(requests, {"fields": fields, "errors": errors})


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0)


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def to_rows(accepted_inserts: DataFrame, *keep: str) -> DataFrame:
    """Accepted requests as typed columns, next to the columns in `keep`."""
    fields = F.col("fields")
    return accepted_inserts.select(*keep, *[typed(fields[c], c).alias(c) for c in WRITABLE])
