from __future__ import annotations

import json

import pytest
from conftest import SF, plan
from pyspark.sql import functions as F

from visitbook.operators import invoice
from visitbook.plans import stand_ins
from visitbook.plans.catalog import QUERIES
from visitbook.plans.requests import billing
from visitbook.schemas import INVOICE
from visitbook.sources.invoices import parse_invoices, read_invoices


def doc(id, sections, pourcentage=None, **more):
    meta = {"nom": "N", "prenom": "P"} | ({} if pourcentage is None else {"pourcentage": pourcentage})
    return {"invoice_id": id, "meta": meta, "sections": sections} | more


def section(titre, *articles):
    return {"titre": titre, "articles": [
        {k: v for k, v in zip(("libelle", "quantite", "montant"), a) if v is not ...} for a in articles
    ]}


@pytest.fixture
def read(spark, tmp_path):
    def _read(*docs):
        path = tmp_path / "invoices.json"
        path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
        return read_invoices(spark, str(path))

    return _read


def priced(df):
    return invoice.price(invoice.accepted_invoices(invoice.check_invoices(df)))


def test_rounding_and_totals(read):
    df = read(doc(1, [section("A", ("x", 1, 5), ("y", 1, 7)), section("A", ("z", 2, 10))], "50"))
    lines = invoice.invoice_lines(priced(df), "invoice_id").orderBy("section_pos", "article_pos").collect()
    assert [(r.section_pos, r.article_pos, r.net) for r in lines] == [(0, 0, 2), (0, 1, 4), (1, 0, 10)]
    total = invoice.with_totals(priced(df)).first()
    assert [tuple(s) for s in total.subtotals] == [("A", 6), ("A", 10)] and total.total == 16


def test_defaults(read):
    df = read(doc(1, [{"articles": [{"montant": 4}, {"quantite": 3}]}, {"titre": "B"}]))
    got = invoice.with_totals(priced(df)).first()
    assert [tuple(s) for s in got.subtotals] == [("Section", 4), ("B", 0)]
    line = invoice.invoice_lines(priced(df)).first()
    assert (line.libelle, line.quantite, line.montant, line.net) == ("", 1.0, 4.0, 4)


def test_numbers_as_text(read):
    df = read(doc(1, [section("A", ("x", "2", "10.5"))], 20))
    assert invoice.with_totals(priced(df)).first().total == 17


def test_rejected(read):
    df = read(
        doc(1, [section("A", ("x", 1, 1))]),
        {"invoice_id": 2, "sections": []},
        {"invoice_id": 3, "meta": {}},
        doc(4, [section("A", ("x", 1, 1))], ""),
        doc(5, [section("A", ("x", "many", 1))]),
        doc(6, [section("A", ("x", 1, 1))], "a third"),
        "not json",
    )
    got = {r.invoice_id: list(r.errors) for r in invoice.check_invoices(df).collect()}
    assert got == {
        1: [], 2: ["meta is required"], 3: ["sections are required"], 4: ["pourcentage must be a number"],
        5: ["quantite and montant must be numbers"], 6: ["pourcentage must be a number"],
        None: ["meta is required", "sections are required"],
    }


def test_valid_articles(read):
    df = read(
        doc(1, [
            section(" A ", (" x ", 0, 5), ("free", 1, 0), ("  ", 1, 5), ("neg", 1, -1), ("none", ..., 5)),
            section("empty", ("x", 0, 1)),
            section(" ", ("x", 1, 1)),
        ]),
        doc(2, [section("", ("x", 1, 1))]),
        doc(3, []),
    )
    kept = invoice.keep_valid_articles(invoice.accepted_invoices(invoice.check_invoices(df))).collect()
    assert [r.invoice_id for r in kept] == [1]
    assert [(s.titre, [a.libelle for a in s.articles]) for s in kept[0].sections] == [("A", ["free"])]


def test_billing(read):
    got = billing(read(doc(1, [section("A", (" x ", 3, 10))], "80"), {"invoice_id": 2}))
    assert tuple(got["lines"].select("libelle", "net").first()) == ("x", 6)
    assert got["totals"].first().total == 6
    assert [r.invoice_id for r in got["rejected"].collect()] == [2]


def test_parse_invoices(spark):
    texts = [(1, json.dumps(doc(9, [section("A", ("x", 1, 2))]))), (2, "broken"), (3, None)]
    df = parse_invoices(spark.createDataFrame(texts, "k int, t string"), F.col("t"), "k")
    assert df.columns == ["k", *INVOICE.names]
    assert {r.k: r.invoice_id for r in df.collect()} == {1: 9, 2: None, 3: None}


def test_nested_totals_do_not_shuffle(spark):
    text = plan(QUERIES["nested_invoice_totals"](spark, SF))
    assert "Exchange" not in text


def test_json_is_parsed_once(spark):
    text = plan(QUERIES["rejected_invoices"](spark, SF), "simple")
    assert text.count("from_json") == 1


def test_lines_sum_to_totals(spark):
    lines = QUERIES["invoice_lines"](spark, SF)
    totals = invoice.line_totals(lines, "l_orderkey", "l_returnflag")
    sums = {r.is_total: r.s for r in totals.groupBy("is_total").agg(F.sum("amount").alias("s")).collect()}
    assert sums[True] == sums[False] == lines.agg(F.sum("net")).first()[0]
    assert plan(totals).count("ReadSchema") == 1


def test_nested_lines_sum_to_totals(spark):
    df = invoice.price(invoice.keep_valid_articles(
        invoice.accepted_invoices(invoice.check_invoices(stand_ins.invoices(spark, SF)))))
    lines = invoice.invoice_lines(df).agg(F.sum("net")).first()[0]
    assert lines == invoice.with_totals(df).agg(F.sum("total")).first()[0]


def test_coverage_split(spark):
    items = [
        (1, "1", "10 000"), (2, "1", "10 001"), (3, "2", "5"), (3, "1 0", "1"), (4, "2", "10 000"), (4, "3", "abc"),
        (5, None, "1"), (6, "1", ""), (7, "4000000000", "4000000000"), (8, "9223372036854775807", "1"), (8, "1", "1"),
        (9, "-1", "9223372036854775807"), (10, "99999999999999999999", "1"), (10, "1", None),
    ]
    checked = invoice.check_items(spark.createDataFrame(items, "i int, q string, p string"), "i", "q", "p")
    got = {r.i: (r.total, r.insurer, r.patient) for r in invoice.coverage_split(checked).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: (10000, 8000, 2000), 2: (10001, 8000, 2001), 3: (20, 16, 4)}
    assert got.keys() == {1, 2, 3, 9} and all(total == a + b for total, a, b in got.values())
    number, needed = "quantity and price must be whole numbers", "quantity and price are required"
    assert {r.i: list(r.errors) for r in invoice.rejected_invoices(checked).collect()} == {
        4: [number], 5: [needed], 6: [number], 7: ["total is too large"], 8: ["total is too large"], 10: [needed, number],
    }


def test_every_bill_is_split_or_refused(spark):
    checked = invoice.check_items(stand_ins.items(spark, SF), "l_orderkey", "quantity", "price")
    split, refused = invoice.coverage_split(checked), invoice.rejected_invoices(checked)
    assert split.where("insurer + patient <> total").isEmpty()
    orders = stand_ins.table(spark, SF, "lineitem").select("l_orderkey").distinct().count()
    assert split.count() + refused.count() == orders and not refused.isEmpty()


ODD = ["nan", "inf", "-Infinity", "1e300", "1e20"]


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("field", ["percent", "quantity", "amount"])
def test_what_cannot_be_priced_is_refused_alone(read, odd, field):
    values = {"percent": "20", "quantity": "3", "amount": "1000"} | {field: odd}
    df = read(
        doc(1, [section("A", ("x", values["quantity"], values["amount"]), ("y", 1, 2))], values["percent"]),
        doc(2, [section("A", ("x", 1, 5))]),
    )
    got = {r.invoice_id: r.total for r in invoice.with_totals(priced(df)).collect()}
    assert got == {2: 5}
    checked = invoice.check_invoices(df, form=True)
    formed = invoice.price(invoice.keep_valid_articles(invoice.accepted_invoices(checked)))
    dropped = odd == "nan" and field != "percent"  # a form leaves such an article out
    assert {r.invoice_id: r.total for r in invoice.with_totals(formed).collect()} == ({1: 2, 2: 5} if dropped else {2: 5})


def test_labels_of_odd_numbers(one):
    from visitbook.functions import labels

    c = F.col("x")
    assert list(one("x double", (float("nan"),), labels.money_label(c), labels.insurer_label(c))) == [None, None]
