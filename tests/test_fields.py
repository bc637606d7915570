from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from visitbook.functions import fields, labels


def over(spark, values, kind, f):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(out, key=lambda r: r.i)]


def python_float(s):
    try:
        return float(s) if s not in (None, "") else None
    except ValueError:
        return None


def test_parse_float_matches_python(spark):
    values = ["1", "-2.5", "+3", ".5", "5.", "1e5", "1E-2", " 7 ", "1_0", "1__0", "_1", "nan", "Inf", "-infinity",
              "1d", "1f", "0x1p3", "abc", "", None, "1,5", "12\n", "--1", "1e", "."]
    got = over(spark, values, "string", fields.parse_float)
    for value, have in zip(values, got):
        want = python_float(value)
        assert (have is None and want is None) or have == want or (math.isnan(have) and math.isnan(want)), value


def test_parse_int(spark):
    values = ["12", " 12 ", "+5", "-3", "1_0", "12.5", "", "x", None, "99999999999"]
    assert over(spark, values, "string", fields.parse_int) == [12, 12, 5, -3, 10, None, None, None, None, None]
    assert over(spark, ["", "12.5", None, "4"], "string", fields.age_part) == [0, None, None, 4]


def test_not_parsed(spark):
    f = lambda c: fields.not_parsed(c, fields.parse_float(c))
    assert over(spark, ["abc", "", None, "1"], "string", f) == [True, False, False, False]


def test_age(one):
    row = one(
        "y int, m int, d int", (1, 6, 10),
        fields.age_in_years(F.col("y"), F.col("m"), F.col("d")).alias("age"),
    )
    assert row.age == round(1 + 6 / 12 + 10 / 365, 10) == 1.5273972603
    parts = one("a double", (1.5273972603,), *fields.age_parts(F.col("a")))
    assert tuple(parts) == (1, 6, 9)


def test_round_half_even(spark):
    assert over(spark, [2.5, 3.5, -2.5, 2.4999], "double", fields.round_half_even) == [2, 4, -2, 2]


def test_spaced_int(spark):
    assert over(spark, ["10 000", "7", "x", "1 0 0"], "string", fields.spaced_int) == [10000, 7, None, 100]


def test_clinic_day(spark):
    late = dt.datetime(2024, 5, 1, 23, 30)
    df = spark.createDataFrame([(late,)], "t timestamp_ntz")
    assert df.select(fields.clinic_day(F.col("t"), "+01:00")).first()[0] == dt.date(2024, 5, 2)
    assert df.select(fields.clinic_day(F.col("t").cast("timestamp"), "+01:00")).first()[0] == dt.date(2024, 5, 2)


def test_age_label(spark):
    def label(c):
        return labels.age_label(c["a"], c["y"], c["m"], c["d"])

    kind = "struct<a:double,y:int,m:int,d:int>"
    values = [(1.5, 1, 6, 0), (1.5, 0, 6, 10), (1.5, 1, None, 3), (0.0, 1, 1, 1), (None, 1, 1, 1), (2.0, 2, 0, 0)]
    assert over(spark, values, kind, label) == ["1 ans 6 mois", "6 mois 10 jours", "1 ans 3 jours", "", "", "2 ans"]


def test_unit_label(spark):
    values = [70.0, 70.5, 0.0, None, 12345678.25, 0.0001]
    assert over(spark, values, "double", lambda c: labels.unit_label(c, "kg")) == [
        "70 kg", "70.5 kg", "", "", "12345678.25 kg", "0.0001 kg"
    ]


@pytest.mark.parametrize("value,shown", [
    (0.25, "0.3"), (0.35, "0.3"), (0.45, "0.5"), (1.05, "1.1"), (1.15, "1.1"), (2.0, "2.0"), (-0.25, "-0.3"), (49.011, "49.0"),
])
def test_fixed1(one, value, shown):
    assert one("v double", (value,), labels.fixed1(F.col("v")))[0] == shown


def test_labels(one):
    at = dt.datetime(2024, 8, 5, 9, 7, 3)
    row = one(
        "t timestamp_ntz, x double", (at, 1234.9),
        labels.french_month_label(F.col("t")), labels.french_day_label(F.col("t")), labels.timestamp_label(F.col("t")),
        labels.money_label(F.col("x")), labels.insurer_label(F.lit(20.5)),
        labels.invoice_name(F.lit("Nom"), F.lit("Prenom"), F.col("t")),
        labels.log_line(F.lit(None).cast("string"), F.lit("login"), F.lit(None).cast("string")),
    )
    assert tuple(row) == (
        "Août 2024", "05/08/2024", "2024-08-05 09:07:03", "1234 Fcfa", "79%",
        "facture_Nom_Prenom_20240805_090703.pdf", "UserType: unknown | Action: login | Details: ",
    )
