"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from visitbook.llm import text_arrays as ta
from visitbook.session import settle

MAX_TOKENS = 2048
END_ID = 0
# Short pieces that one task packs together; each group leaves at most a few bins part-filled.
GROUP_PIECES = 1 << 16
# Distinct words whose ids a worker remembers.
CACHED_WORDS = 1 << 18

# Fixed values of byte-level BPE files: how a text is cut before merging, and the string of a
# special token.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Token ids by the tokens' bytes. Printable Latin-1 characters stand for themselves in a
    byte-level vocabulary, the other bytes for the characters from U+0100 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    Byte-level BPE never merges across a blank that stands between two other characters, so a
    text is cut there and each distinct word is merged once.
    """

    def __init__(self, tokenizer_json: str, cached: int = CACHED_WORDS):
        self.slow = Tokenizer.from_str(tokenizer_json)
        ranks = byte_ranks(json.loads(tokenizer_json)["model"]["vocab"])
        self.fast = tiktoken.Encoding(
            "byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.cached = cached
        self.first, self.rest = Words(self.fast, ""), Words(self.fast, " ")

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.rest) + len(self.first) > self.cached:
            self.first, self.rest = Words(self.fast, ""), Words(self.fast, " ")
        parts = text.split(" ")
        try:
            head = self.first.ids([parts[0]])
            return np.concatenate([head, self.rest.ids(parts[1:])]) if len(parts) > 1 else head
        except IrregularSpace:
            return np.array(self.fast.encode_ordinary(text), np.uint32)


class IrregularSpace(Exception):
    """A blank next to other white space: the words of the text depend on each other."""


class Words(dict):
    """Word -> number of its ids in a growing pool; an unseen word is encoded on the way."""

    def __init__(self, encoding: tiktoken.Encoding, before: str):
        super().__init__()
        self.encoding, self.before = encoding, before
        self.pool, self.ends = array("I"), array("q", [0])

    def __missing__(self, word: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            raise IrregularSpace
        self.pool.extend(self.encoding.encode_ordinary(self.before + word))
        self.ends.append(len(self.pool))
        self[word] = n = len(self)
        return n

    def ids(self, words: list[str]) -> np.ndarray:
        at = np.array([self[w] for w in words], np.int64)
        ends, pool = np.frombuffer(self.ends, np.int64), np.frombuffer(self.pool, np.uint32)
        starts, sizes = ends[at], ends[at + 1] - ends[at]
        shift = starts - (np.cumsum(sizes) - sizes)
        return pool[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)]


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `max_tokens` of every text's ids and a closing `end_id`.

    Only longer documents are cut, into full pieces; their first one may be shorter. A null
    text counts as empty and has the closing id alone. Each row of `docs` is a document of its
    own, equal rows too; a null doc_id stays null.
    """
    definition = Path(tokenizer_path).read_text()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(definition)
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    head = (len(ids) - 1) % max_tokens + 1
                    cuts = [0, *range(head, len(ids) + 1, max_tokens)]
                    rows += [
                        (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE_TYPES, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed longest first.

    Of the open bins that have room, an item takes one whose filling makes the sum over gaps of
    (open bins with that gap)**2 smallest: moving a bin from gap g to gap g - x changes it by
    2 * (n[g - x] - n[g] + 1), or by 1 - 2 * n[g] if the bin becomes full. A new bin is opened
    when none has room.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full ones are not counted
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        x = int(lengths[i])
        change = 2 * (count[: capacity + 1 - x] - count[x:] + 1)
        change[0] = 1 - 2 * count[x]
        change[count[x:] == 0] = np.iinfo(np.int64).max
        k = int(np.argmin(change)) if len(change) else 0
        gap = k + x
        if count[gap] == 0:
            b, gap, opened = opened, capacity, opened + 1
        else:
            b = waiting[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > x:
            waiting[gap - x].append(b)
            count[gap - x] += 1
    return bins, offsets


def pack(spark: SparkSession, pieces: DataFrame, max_tokens: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset; a sequence holds up to `max_tokens`.

    Full pieces are sequences by themselves. The others are dealt into groups of about
    `group_pieces` by row number, not by a key, and each group is packed in one task. No rows
    give no sequences.
    """
    stored = settle(pieces, spark, "pieces").withColumn("row", F.monotonically_increasing_id())
    full = stored.where(F.col("length") >= max_tokens)
    short = stored.where(F.col("length") < max_tokens)
    groups = max(1, -(-short.count() // group_pieces))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        bins, offsets = sum_of_squares(group["length"].to_numpy(), max_tokens)
        # Odd numbers, apart for each group; full pieces have the even ones.
        return group[kept].assign(sequence_id=(int(group["part"].iloc[0]) << 32 | bins) * 2 + 1, offset=offsets)

    dealt = short.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("part").applyInPandas(place, PIECES + ", sequence_id bigint, offset bigint")
    alone = full.select(*kept, (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Tokenise, cut and pack whole documents: see token_pieces and pack."""
    return pack(spark, token_pieces(docs, tokenizer_path, max_tokens, end_id), max_tokens, group_pieces)
