from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import SF, awkward, documents, empty, lower
from pyspark.sql import functions as F

from visitbook.llm import hash_buckets as hb
from visitbook.llm import lm_scoring as lm
from visitbook.llm.queries import QUERIES


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", lower(text)), None]


def brute_force(docs, held_out):
    """Base score by exact counts: doc -> n_tokens, n_known, N, score."""
    count = Counter(t for d, text in docs if not held_out(d) for t in tokens(text))
    total, distinct = sum(count.values()), len(count)
    out = {}
    for d, text in docs:
        each = [math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens(text)]
        out[d] = (len(each), sum(count[t] > 0 for t in tokens(text)), total, sum(each))
    return out


def fifth(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 1


def test_query_base_equals_brute_force_and_model_predicts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_force(docs, fifth)
    rows = QUERIES["op8_lm_scoring"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == fifth(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    # On unseen texts the model must not lose to the unigrams; on those it knows it must win.
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n - 0.05
    known = [r for r in rows if not r.held_out]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


@pytest.mark.parametrize("frequent", [1, 1 << 18])
def test_rare_tokens_are_counted_exactly(spark, frequent):
    texts = ["a b a", "A c\tc\nd", None, "", "é É é", "zz zz b", " x ", "a"]
    held = F.col("doc_id").isin(5, 6)
    rows = lm.score_documents(spark, documents(spark, texts), held, frequent_tokens=frequent).collect()
    want = brute_force(list(enumerate(texts)), lambda d: d in (5, 6))
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3])


def test_filter_gives_quantised_counts_back():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    counts = rng.zipf(1.6, len(keys)).clip(1, 10**6)
    one, two = (keys >> lm.GRAM_SHIFT, counts), (keys[:100] >> lm.GRAM_SHIFT, counts[:100])
    bits = 64 * (1 + int(lm.levels_of(counts, 1).sum()) * 3 * lm.ENTRY_BITS // 64)
    field, cut_1, cut_2 = lm.segment(one, two, bits)
    model = lm.Model(1, bits, np.frombuffer(field, np.uint8)[None, :], np.array([[cut_1, cut_2]]), 1, 1, keys[:0], counts[:0])
    read = model.levels(keys, lm.UNIGRAM, np.full(len(keys), lm.LEVELS - 1))
    true = lm.levels_of(counts, cut_1)
    assert cut_1 == 1 and (read >= true).all()  # a filter has false hits only
    assert (read == true).mean() > 0.97
    guess = model.estimates(keys, lm.UNIGRAM, true)
    assert (guess >= counts / 2).all() and (guess <= counts * 2).all()


def test_small_filter_leaves_out_the_rarest(spark):
    counts = np.array([1] * 1000 + [50] * 10)
    keys = np.arange(1, 1011, dtype=np.uint64) << np.uint64(40)
    _, cut_1, _ = lm.segment((keys, counts), (keys[:0], counts[:0]), 2048)
    assert 1 < cut_1 <= 50


@pytest.mark.parametrize("span_bytes", [1, 30_000, 1 << 24])
def test_filter_grows_with_the_grams(spark, span_bytes):
    # More grams than text bytes allow for, and small chunks and buckets: none is left out.
    rng = np.random.default_rng(4)
    texts = [" ".join(chr(97 + c) for c in rng.integers(0, 26, 2000)) for _ in range(40)] + [
        " ".join(format(c, "x") for c in rng.integers(0, 1 << 16, 2000)) for _ in range(40)
    ]
    docs = documents(spark, texts).repartition(3)
    model, segments, _ = lm.train(spark, docs.select("text"))
    assert (model.cutoffs == 1).all()
    numbered = docs.select(F.col("doc_id").alias("row"), "doc_id", F.lit(1).cast("bigint").alias("copies"), "text")
    chunks = lm.settle(lm.chunked(numbered), spark, "chunks")
    read = lm.with_levels(chunks, lm.probe(spark, chunks, segments, model.buckets, span_bytes)).toArrow()
    one, two = Counter(t for x in texts for t in tokens(x)), Counter()
    for x in texts:
        two.update(zip([None, *tokens(x)], tokens(x), strict=False))
    rows = 0
    for chunk in lm.read_chunks(read.to_batches()):
        bounds = chunk.bounds()
        for r, doc in enumerate(chunk.rows.field("doc_id").to_pylist()):
            a, b = bounds[r], bounds[r + 1]
            mine = tokens(texts[doc])
            for found, counts in (
                (chunk.one[chunk.index[a:b]], [one[t] for t in mine]), (chunk.pair[a:b], [two[p] for p in zip([None, *mine], mine, strict=False)]),
            ):
                true = lm.levels_of(np.array(counts), 1)
                assert (found >= true).all() and (found == true).mean() > 0.9
            rows += 1
    assert rows == len(texts)


def test_weights_come_from_all_texts_and_copies_count_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    loose = [" ".join(format(c, "x") for c in rng.integers(0, 60, 40)) for _ in range(400)]
    group = [" ".join(f"only{c}" for c in range(40))] * 64
    seen = []

    def fit(shared, read, own=lm.fit_weights):
        rows = read.select(F.inline("rows")).collect()
        seen.append(({r.doc_id: r.copies for r in rows}, own(shared, read)))
        return seen[0][1]

    monkeypatch.setattr(lm, "fit_weights", fit)
    lm.score_documents(spark, documents(spark, [*loose, *group, "held out"]), F.col("doc_id") == 464)
    copies, weights = seen[0]
    assert copies == {i: 1 if i < 400 else 64 if i < 464 else 0 for i in range(465)}
    # Contexts seen 64 times occur in the copies only: without these there is nothing to trust.
    assert weights[int(lm.levels_of(np.array([64]), 1)[0])] == 0


def levels(count):
    return int(math.log2(count)) + 1 if count else 0


def middle(level):
    """What a level stands for on average."""
    return (2 ** (level - 1) + max(2**level - 1, 2 ** (level - 1))) / 2 if level else 0.0


def exact_scores(docs, held_out):
    """The model's scores with exact levels instead of a filter: doc -> score."""
    learned = [text for d, text in docs if not held_out(d)]
    one, two, copies = Counter(), Counter(), Counter(text or "" for text in learned)
    for text in learned:
        one.update(tokens(text))
        two.update(zip([None, *tokens(text)], tokens(text), strict=False))
    total, distinct = sum(one.values()), len(one)

    def less(estimate, left_out):
        return 0.0 if left_out >= (estimate + 0.5) / 1.5 - 1e-9 else max(estimate - left_out, 0)

    def parts(text, left_out):
        for u, v in zip([None, *tokens(text)], tokens(text), strict=False):
            before, count = middle(levels(one[u])), middle(levels(one[v]))
            most = min(min(levels(one[u]), levels(one[v])) + 1, lm.LEVELS - 1) if one[u] else 0
            pair = min(middle(min(levels(two[u, v]), most)), before)
            p1 = min(1.0, (less(count, left_out) + 0.5) / (total + 0.5 * (distinct + 1)))
            yield p1, min(1.0, less(pair, left_out) / max(less(before, left_out), 1)), levels(one[u])

    gains = np.zeros((lm.LEVELS, len(lm.WEIGHTS)))
    for text in learned:
        for p1, p2, level in parts(text, copies[text or ""]):
            gains[level] += np.log(lm.WEIGHTS * p2 + (1 - lm.WEIGHTS) * p1) / copies[text or ""]
    weights = lm.WEIGHTS[np.argmax(gains, axis=1)]
    return {d: sum(math.log10(weights[k] * p2 + (1 - weights[k]) * p1) for p1, p2, k in parts(text, 0)) for d, text in docs}


def test_score_equals_exact_model(spark):
    rng = np.random.default_rng(11)
    zipf = lambda: rng.zipf(1.5, 60).clip(1, 400)
    texts = [" ".join(f"w{c}" for c in zipf()) for _ in range(60)] + [None, "", "W1 w2\tW1"]
    texts += [texts[0]] * 5 + ["new words w1 w1 only"]
    docs, held = list(enumerate(texts)), lambda d: d % 7 == 3 or d == 68
    column = (F.col("doc_id") % 7 == 3) | (F.col("doc_id") == 68)
    # So many bits an entry that there are next to no false hits; the filter is broadcast in many spans.
    rows = lm.score_documents(spark, documents(spark, texts), column, entry_bits=512, span_bytes=20_000).collect()
    want = exact_scores(docs, held)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)


def test_keys_pack_and_unpack():
    rng = np.random.default_rng(3)
    for high in (1 << 20, 1 << 62):
        keys = np.unique(rng.integers(0, high, 1000, dtype=np.uint64))
        counts = rng.integers(1, 1 << 40, len(keys))
        for k, c in ((keys, counts), (keys, counts % 200 + 1), (keys[:1], counts[:1])):
            a, b = hb.unpacked(*hb.packed(k, c))
            assert (a == k).all() and (b == c).all()


def test_awkward_rows(spark):
    held = F.col("doc_id") == 2
    rows = lm.score_documents(spark, awkward(spark).withColumnRenamed("lang", "score"), held).collect()
    assert len(rows) == 11 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert lm.score_documents(spark, empty(spark), held).count() == 0
    untaught = lm.score_documents(spark, awkward(spark), F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known) for r in untaught} == {(0, 0)}
