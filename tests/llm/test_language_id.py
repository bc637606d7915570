from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SF, awkward, documents, empty
from pyspark.sql import functions as F

from visitbook.llm import language_id as li
from visitbook.llm.queries import QUERIES

SMALL = {"a": Counter({"abab": 3, "ba": 2, "aab": 1}), "b": Counter({"bcc": 2, "cb": 4, "éb": 1})}


def plain_kneser_ney(counts, order, symbols):
    """Interpolated Kneser-Ney over words, from its definition."""
    raw = [Counter() for _ in range(order + 1)]
    for word, k in counts.items():
        s = "\x02" + word + "\x03"
        for n in range(1, order + 1):
            for i in range(len(s) - n + 1):
                raw[n][s[i : i + n]] += k
    used = [Counter() for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g in raw[n]:
            if n == order or g[0] == "\x02":
                used[n][g] = raw[n][g]
            else:
                used[n][g] = sum(1 for h in raw[n + 1] if h[1:] == g)
    discounts = []
    for n in range(1, order + 1):
        seen = [c for g, c in used[n].items() if g != "\x02"]
        once, twice = seen.count(1), seen.count(2)
        discounts.append(once / (once + 2 * twice) if once and twice else 0.5)

    def p(context, c):
        q = 1 / symbols
        for n in range(1, min(order, len(context) + 1) + 1):
            h = context[len(context) - n + 1 :]
            after = {g: k for g, k in used[n].items() if g[:-1] == h and g != "\x02"}
            total = sum(after.values())
            if not total:
                continue
            d = discounts[n - 1]
            q = max(after.get(h + c, 0) - d, 0) / total + d * len(after) / total * q
        return q

    return p


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_model_equals_the_definition(order):
    model = li.fit(SMALL, order)
    symbols = len(set("".join("".join(c) for c in SMALL.values()))) + 2
    texts = ["abab ba", "cb bcc", "éb zq", "aab", "b"]
    bits, sizes = li.TextScorer(model)(texts)
    for k, lang in enumerate(model.languages):
        p = plain_kneser_ney(SMALL[lang], order, symbols)
        for i, text in enumerate(texts):
            want = 0.0
            for word in text.split():
                s = "\x02" + word + "\x03"
                want -= sum(math.log2(p(s[:j], s[j])) for j in range(1, len(s)))
            assert bits[i, k] == pytest.approx(want, rel=1e-5), (text, lang)
    assert sizes.tolist() == [sum(len(w) + 1 for w in t.split()) for t in texts]


def test_held_out_accuracy_and_contract(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = Counter()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.held_out:
            right[r.lang_pred == docs[r.doc_id].lang] += 1
    assert right[True] >= 0.97 * sum(right.values())


def test_held_out_rows_do_not_teach(spark):
    docs = [(i, "abab baba", "a") for i in range(9)] + [(i, "cdcd dcdc", "b") for i in range(9, 30)]
    taught = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 != 1 or d[2] == "a"]
    frame = spark.createDataFrame(taught, "doc_id bigint, text string, lang string")
    model = li.train(frame.where(li.fold(frame.doc_id, 3) != 1))
    assert model.languages == ["a", "b"]


def test_rejection_is_calibrated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.train(docs)
    rng = np.random.default_rng(1)
    noise = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 2000))
    rows = li.identify(documents(spark, [noise, "", None, "123 !?", "the"]), model).collect()
    assert [r.rejected for r in sorted(rows, key=lambda r: r.doc_id)] == [True, True, True, True, False]
    judged = li.identify(docs, model).where("rejected").count()
    assert judged <= 0.01 * docs.count()


def test_a_language_without_calibration_rejects_junk_only(spark):
    """One labelled document: texts of the language stay, letters at random go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = docs.where("lang = 'es'").agg(F.min("doc_id")).first()[0]
    model = li.train(docs.withColumn("lang", F.when((F.col("lang") != "es") | (F.col("doc_id") == first), F.col("lang"))))
    assert np.isfinite(model.mean).all() and "es" in model.languages
    assert li.identify(docs.where("lang = 'es'"), model).where("rejected").count() == 0
    rng = random.Random(2)
    junk = [" ".join("".join(rng.choices("qwxzkjvbnmlpgfdsaeiouyrtch", k=7)) for _ in range(60)) for _ in range(20)]
    assert li.identify(documents(spark, junk), model).where("NOT rejected").count() == 0


def test_awkward_rows(spark):
    model = li.train(awkward(spark))
    rows = li.identify(awkward(spark).withColumnRenamed("source", "score"), model).collect()
    assert len(rows) == 11
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.lang_pred)
    assert by_id[3] == by_id[4] == by_id[5] == by_id[8] == {"und"}
    assert li.identify(empty(spark), model).count() == 0
    untaught = li.train(empty(spark))
    assert {r.lang_pred for r in li.identify(awkward(spark), untaught).collect()} == {"und"}
