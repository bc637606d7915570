from __future__ import annotations

import hashlib

import pytest
from cases import SF, awkward, documents, empty, words

from visitbook.llm import decontamination as dc
from visitbook.llm.queries import QUERIES


def brute_force(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(g) for g in grams}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if owners := grams.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        names = ",".join(sorted(found))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {
        r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        for r in QUERIES["op5_decontamination"](spark, SF).collect()
    }
    assert got == brute_force(docs, items)
    assert any(v[4] for v in got.values())


@pytest.mark.parametrize("slice_windows", [3, 1 << 20])
def test_short_items_overlaps_and_slices(spark, slice_windows):
    texts = [
        "A b C d", "b c", "x b c b c y", "é Ü b c", "q w e r t z u i o p a", "zz Q W E R T Z U I O P a end",
        "b,c", "bc", "", None, "e r t z u i o p a q",
    ]
    items = [(1, "B c"), (2, "q w e r t z u i o p a"), (3, ""), (4, None), (5, "b C"), (6, "Ü")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = dc.contamination(documents(spark, texts), benchmark, slice_windows=slice_windows).collect()
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"])) for r in rows}
    want = brute_force(list(enumerate(texts)), items)
    assert got == {k: v[:3] for k, v in want.items()}


def test_removal_keeps_clean_texts_and_drops_bare_ones(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    benchmark = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    texts = [f"Before it, {passage.upper()} - and after.", passage, "a clean text", None, "", "..."]
    rows = {r.doc_id: r for r in dc.decontaminate(documents(spark, texts), benchmark).collect()}
    assert rows[0].text == "Before it,  - and after." and rows[0].n_chars == len(rows[0].text)
    assert 1 not in rows
    assert [rows[i].text for i in (2, 3, 4, 5)] == texts[2:]


def test_awkward_rows(spark):
    benchmark = spark.createDataFrame([(None, "two three four five six seven eight nine ten eleven"), (2, "é")], "item_id bigint, text string")
    docs = awkward(spark).withColumnRenamed("source", "items").withColumnRenamed("lang", "spans")
    rows = dc.contamination(docs, benchmark).collect()
    assert len(rows) == 11
    assert [sum(s.end - s.start for s in r.spans) for r in rows if r.doc_id in (1, 2)] == [10, 10, 10]
    assert dc.decontaminate(awkward(spark), benchmark).count() == 10  # the text that is only a hit goes
    assert dc.contamination(empty(spark), benchmark).count() == 0
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.decontaminate(awkward(spark), nothing).count() == 11
