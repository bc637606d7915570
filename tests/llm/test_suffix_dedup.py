from __future__ import annotations

import hashlib
import random

import pytest
from cases import SF, awkward, documents, empty

from visitbook.llm import suffix_dedup as sd
from visitbook.llm.queries import QUERIES


def brute_force(docs, length=100):
    """Rows in the given order; per row n_bytes, n_removed, n_spans, kept_sha256."""
    seen, out = set(), []
    for text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in rows], brute_force([r.text for r in rows]), strict=True))
    assert got(QUERIES["op3_suffix_dedup"](spark, SF)) == want
    assert sum(v[1] > 0 for v in want.values()) > 5


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 9)))
    base = " ".join(word() for _ in range(150))
    near = []
    for i in range(40):
        w = base.split()
        w[rng.randrange(150)] = f"edit{i}"
        near.append(" ".join(w))
    passage = base[200:420]
    return [
        base, base, *near, base[:99], base[:100], base[37:137], "x" * 350, "x" * 99, "ab" * 200, None, "",
        *[f"{word()} {passage} {word()}" for _ in range(20)], base + base, "é" * 120, passage[:150] + passage[50:],
    ]


@pytest.mark.parametrize("options", [{}, {"hot_segments": 5}, {"filter_bits": 0}, {"filter_bits": 0, "hot_segments": 9}])
def test_every_path_equals_brute_force(spark, texts, options):
    want = dict(enumerate(brute_force(texts)))
    assert got(sd.remove_repeats(spark, documents(spark, texts), **options)) == want


def test_small_blocks_and_packs(spark, texts, monkeypatch):
    for name, value in (("BLOCK_SEGMENTS", 3), ("PACK_SEGMENTS", 5), ("BUCKET_SEGMENTS", 40), ("SLICE_BYTES", 500)):
        monkeypatch.setattr(sd, name, value)
    assert got(sd.remove_repeats(spark, documents(spark, texts))) == dict(enumerate(brute_force(texts)))


def test_difference_cover():
    assert all(any((d + a) % sd.PERIOD in sd.COVER and (d + b) % sd.PERIOD in sd.COVER for d in range(sd.PERIOD))
               for a in range(sd.PERIOD) for b in range(sd.PERIOD))
    for d in range(sd.LENGTH):
        first, last = sd.cover_steps(d)
        assert first < sd.PERIOD and first + sd.SAMPLE >= last and sd.LENGTH - sd.PERIOD < last + sd.SAMPLE <= sd.LENGTH


def test_awkward_rows(spark):
    rows = sd.remove_repeats(spark, awkward(spark).withColumnRenamed("lang", "name")).collect()
    assert len(rows) == 11
    assert {r.n_removed for r in rows if r.doc_id in (1, 2, 3, 4)} == {0}
    assert [r.n_removed for r in rows if r.doc_id == 9] == [49_999]
    line = "one line that is surely longer than a hundred bytes, so that it can be removed where it comes up again, somewhere"
    twice = documents(spark, [line, "x " + line]).unionAll(documents(spark, [line, "x " + line]))
    assert sorted((r.doc_id, r.n_removed) for r in sd.remove_repeats(spark, twice).collect()) == [
        (0, 0), (0, 0), (1, len(line)), (1, len(line)),
    ]
    assert sd.remove_repeats(spark, empty(spark)).count() == 0
