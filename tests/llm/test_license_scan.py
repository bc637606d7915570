from __future__ import annotations

import pytest
from cases import SF, awkward, documents, empty, words

from conftest import plan
from visitbook.llm import license_scan as lic
from visitbook.llm.queries import QUERIES


def base(text):
    w = words(text)
    found = [
        (i, label) for label, phrase in lic.PHRASES for p in [phrase.split()]
        for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p
    ]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({a for _, a in found}))


def got(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()}


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got(QUERIES["op7_license_scan"](spark, SF)) == {d: base(t) for d, t in texts.items()}


TEXTS = [
    "Under THE mit-license, under the MIT license", "cc by nc cc by nc by nc", "Apache License, Version 2.0",
    "under the m it license", "K license under the mit license", "under the\u212amit license", "cc by", "", None, "İcc by nc",
    "This work is Licensed under the GNU General Public License, version 3.",
    "permission is hereby granted free of charge to any individual person obtaining a copy of this software and associated documentation files",
    "redistribution and use in source with modification are permitted", "x " * 300 + "cc by nc",
]


def test_base_places(spark):
    assert got(lic.scan_licenses(spark, documents(spark, TEXTS))) == {i: base(t) for i, t in enumerate(TEXTS)}


def test_labels_of_the_method(spark):
    rows = {r.doc_id: r for r in lic.scan_licenses(spark, documents(spark, TEXTS)).collect()}
    assert rows[0].labels == "mit" and rows[0].score == 1.0
    assert "gpl-3" in rows[10].labels.split(",") and rows[10].score == 1.0
    assert rows[11].labels == "mit" and 0.75 <= rows[11].score < 1  # one word put in: two neighbouring diagonals
    assert rows[12].labels == "" and 0 < rows[12].score < 0.75
    assert rows[7].score == 0 and rows[8].labels == ""


def test_plan_has_no_python_and_no_cross_join(spark):
    text = plan(lic.scan_licenses(spark, documents(spark, ["a"])), "simple")
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_awkward_rows(spark):
    rows = lic.scan_licenses(spark, awkward(spark).withColumnRenamed("lang", "label")).collect()
    assert len(rows) == 11 and all(r.n_base == 0 for r in rows)
    twice = documents(spark, ["cc by nc"]).unionAll(documents(spark, ["cc by nc"]))
    assert [r.n_base for r in lic.scan_licenses(spark, twice).collect()] == [1, 1]
    assert lic.scan_licenses(spark, empty(spark)).count() == 0
    with pytest.raises(ValueError):
        lic.scan_licenses(spark, awkward(spark), templates=[("x", "two words")])
