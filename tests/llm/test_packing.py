from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from cases import SF, awkward, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from visitbook.llm import packing
from visitbook.llm.queries import QUERIES, tokenizer_path

TOKENIZER = Tokenizer.from_file(tokenizer_path())
ENCODER = packing.Encoder(open(tokenizer_path()).read())


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'  \n\té1,<|>\x1c\x85 　İ😀st"), max_size=40) | st.text(max_size=30))
def test_ids_equal_the_tokenizer(text):
    if text.encode("utf-8", "ignore").decode() == text:  # no lone surrogates in a Spark string
        assert ENCODER(text).tolist() == ids(text)


def test_special_token_string():
    text = "a <|endoftext|> b"
    assert ENCODER(text).tolist() == ids(text)


def check(rows, texts, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        tokens = np.array([*ids(texts[doc]), 0], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for k, r in enumerate(pieces):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(tokens[at : at + r.length].tobytes()))
            assert r.length == capacity or k == 0 and 0 < r.length <= capacity
            at += r.length
        assert at == len(tokens)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_query_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sequences, tokens = check(QUERIES["op6_packing"](spark, SF).collect(), texts, 2048)
    assert sequences <= -(-tokens // 2048) + 2


def test_small_groups_and_capacity(spark):
    texts = {i: "word " * (i % 23) for i in range(300)}
    rows = packing.pack_documents(spark, documents(spark, list(texts.values())), tokenizer_path(), max_tokens=16, group_pieces=50)
    check(rows.collect(), texts, 16)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 20)
    filled = defaultdict(int)
    for i in sorted(range(len(lengths)), key=lambda i: (bins[i], offsets[i])):
        assert offsets[i] == filled[bins[i]]
        filled[bins[i]] += lengths[i]
    assert all(v <= 20 for v in filled.values())


def test_least_sum_of_squares_by_hand():
    # 12 opens a bin (gap 8), 11 another (gap 9), 9 fills the second; 8 then fills the first.
    assert packing.sum_of_squares(np.array([12, 11, 9, 8]), 20)[0].tolist() == [0, 1, 1, 0]


def test_awkward_rows(spark):
    rows = packing.pack_documents(spark, awkward(spark).withColumnRenamed("source", "offset"), tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in rows) == 11
    assert [r.length for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert packing.pack_documents(spark, empty(spark), tokenizer_path()).count() == 0
