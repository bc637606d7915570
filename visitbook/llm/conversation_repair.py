"""Repair of conversations whose rows were lost, emptied, cut off, repeated or mislabelled.

Rows are put in order and given one letter each, role and fault. Letters are gathered in chunks
of bounded length; each chunk gives the cheapest ways between the stacks of the role grammar (see
`role_grammar`), and a conversation's chunks are joined in order. So a conversation may span any
number of partitions. The repaired rows are written by a pass in order that knows the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.llm import role_grammar as grammar
from visitbook.llm.ordered_rows import group_key, in_order, key_value
from visitbook.session import settle

# What separates words, and what may end a text.
SPACES = "\t\n\x0b\x0c\r "
ENDS = (".", "!", "?")
# Rows of one chunk of letters, as a power of two.
CHUNK_BITS = 12
# Characters of a text by which a range of equal keys may be split.
SPLIT_CHARS = 32

COUNTS = "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
ORDERED = ["conv", "turn", "role", "text"]


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv (a key that null has too), turn, role, text, row: a conversation's rows by turn.

    Null turns come first; rows of one turn stand by role and text. Null roles and texts read as
    one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    named = rows.select(group_key(F.col("conv_id")).alias("conv"), "turn", blank("role"), blank("text"))
    ranges = ["conv", "turn", "role", F.left("text", F.lit(SPLIT_CHARS))]
    return in_order(named, ranges, ["text"])


def faults(turns: DataFrame) -> DataFrame:
    """Adds `fault`, the first that applies: blank, repeated (role and text seen earlier in the
    conversation), truncated (does not end a sentence), or none.

    Only role and text that occur several times are joined back, written out first, so their
    size decides how, and a very frequent one may be split.
    """
    end = F.rtrim("text", F.lit(SPACES))
    marked = turns.withColumns({
        "said": F.md5(F.concat("role", F.lit("\n"), "text")),
        "fault": F.when(end == "", grammar.BLANK)
        .when(F.right(end, F.lit(1)).isin(*ENDS), grammar.SOUND).otherwise(grammar.CUT_OFF),
    })
    said = marked.where(F.col("fault") != grammar.BLANK).groupBy("conv", "said")
    several = said.agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = marked.join(settle(several, turns.sparkSession, "said"), ["conv", "said"], "left")
    again = (F.col("row") > F.col("first_row")) & (F.col("fault") != grammar.BLANK)
    return met.withColumn("fault", F.when(again, grammar.REPEATED).otherwise(F.col("fault"))).drop("said", "first_row")


def chunk_letters(turns: DataFrame) -> DataFrame:
    """conv, chunk, first (whether the conversation begins there), codes: the rows' letters."""
    initial = F.left("role", F.lit(1))
    place = F.when(initial == "", 0).otherwise(F.instr(F.lit(grammar.TERMINALS), initial))
    role = F.when(place > 0, place - 1).otherwise(len(grammar.TERMINALS))
    letter = F.char(F.lit(ord("A")) + role * 4 + F.col("fault"))
    chunks = turns.groupBy("conv", F.shiftright("row", CHUNK_BITS).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("row", letter.alias("code")))).alias("rows")
    )
    return chunks.select("conv", "chunk", F.array_join(F.col("rows.code"), "").alias("codes"))


def _chunk_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk the ways from each stack; a conversation in one chunk needs those from the bottom only."""
    for batch in batches:
        ways = []
        for codes, alone in zip(batch.column("codes").to_pylist(), batch.column("alone").to_pylist(), strict=True):
            if alone:
                ways.append([(0, 0, *grammar.repair(codes))])
                continue
            ways.append([
                (a, grammar.STACKS.index(to), *way)
                for a, reached in enumerate(grammar.transfers(codes)) for to, way in reached.items()
            ])
        listed = [[dict(zip(WAY_FIELDS, w, strict=True)) for w in found] for found in ways]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("conv", "chunk", "alone", "codes")] + [pa.array(listed, WAYS_ARROW)],
            names=["conv", "chunk", "alone", "codes", "ways"],
        )


WAY_FIELDS = ["at", "to", "cost", "audit"]
WAYS = "array<struct<at:int,to:int,cost:bigint,audit:string>>"
WAYS_ARROW = pa.list_(
    pa.struct([("at", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
)


class _Counts:
    """What the letters of a conversation tell, chunk by chunk."""

    def __init__(self) -> None:
        self.faults = [0, 0, 0, 0]
        self.illegal, self.last = 0, ""

    def add(self, codes: str) -> None:
        for code in codes:
            initial, fault = grammar.ROWS[code]
            self.faults[fault] += 1
            self.illegal += bool(self.last) and self.last + initial not in ("su", "ua", "au")
            self.last = initial

    def row(self) -> tuple[int, int, int, int]:
        return self.faults[grammar.BLANK], self.faults[grammar.REPEATED], self.faults[grammar.CUT_OFF], self.illegal


def _joined_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS from chunks that arrive in order of conversation and chunk."""

    def close(conv: str, counts: _Counts, ways: grammar.Ways | None, whole: tuple[int, str] | None) -> tuple:
        return conv, *counts.row(), *(whole or grammar.finish(ways))

    conv, counts, ways, whole = None, _Counts(), {}, None
    for batch in batches:
        out = []
        for chunk in batch.to_pylist():
            if chunk["conv"] != conv:
                if conv is not None:
                    out.append(close(conv, counts, ways, whole))
                conv, counts, ways, whole = chunk["conv"], _Counts(), {grammar.BOTTOM: (0, "")}, None
            counts.add(chunk["codes"])
            if chunk["alone"]:
                whole = (chunk["ways"][0]["cost"], chunk["ways"][0]["audit"])
            else:
                steps: list[dict] = [{} for _ in grammar.STACKS]
                for w in chunk["ways"]:
                    steps[w["at"]][w["to"]] = (w["cost"], w["audit"])
                ways = grammar.joined(ways, steps)
        yield _count_batch(out)
    if conv is not None:
        yield _count_batch([close(conv, counts, ways, whole)])


def _count_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    types = [pa.string(), *[pa.int64()] * 5, pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def judge(turns: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, illegal neighbours, cost and audit of its repair."""
    spark = turns.sparkSession
    chunks = settle(chunk_letters(faults(turns)), spark, "letters")
    alone = settle(chunks.groupBy("conv").agg((F.count(F.lit(1)) == 1).alias("alone")), spark, "alone")
    ways = chunks.join(alone, "conv").mapInArrow(_chunk_ways, f"conv string, chunk bigint, alone boolean, codes string, ways {WAYS}")
    return settle(ways, spark, "ways").repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_joined_chunks, COUNTS)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str, str, bool]]]:
    """Per batch the repaired rows: conv, role, text, whether it is the conversation's first.

    Rows arrive in order; each conversation's edits, as a row of their own, come first.
    """
    conv, audit, at, before, fresh = None, "", 0, "", False
    for batch in batches:
        out: list[tuple[str, str, str, bool]] = []

        def put(role: str, text: str, out: list = out) -> None:
            nonlocal before, fresh
            out.append((conv, role, text, fresh))
            before, fresh = role, False

        def insertions() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                put(grammar.repaired_role("I", "", before), "")

        for row in batch.to_pylist():
            if row["edits"] is not None:
                conv, audit, at, before, fresh = row["conv"], row["edits"], 0, "", True
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(grammar.repaired_role(edit, row["role"], before), row["text"])
            insertions()
        yield out


def _with_edits(turns: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows in order of conversation, each conversation behind its edits; one shuffle."""
    edits = judged.select("conv", F.lit(-1).cast("bigint").alias("row"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), F.col("audit").alias("edits"))
    rows = turns.select("conv", "row", "role", "text", F.lit(None).cast("string").alias("edits"))
    return rows.unionByName(edits).repartition("conv").sortWithinPartitions("conv", "row")


def repaired_turns(turns: DataFrame, judged: DataFrame) -> DataFrame:
    """conv, place (from 0), role, text: the rows of the repaired conversations.

    Rows stream through in order, so memory does not grow with a conversation but for its edits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for rows in _edited(batches):
            places = []
            for *_, fresh in rows:
                place = 0 if fresh else place + 1
                places.append(place)
            convs, roles, texts = ([r[i] for r in rows] for i in range(3))
            arrays = [pa.array(convs, pa.string()), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv", "place", "role", "text"])

    return _with_edits(turns, judged).mapInArrow(run, "conv string, place bigint, role string, text string")


def repaired_digests(turns: DataFrame, judged: DataFrame) -> DataFrame:
    """conv, sha256 of the repaired rows as `role:text`, joined by newlines; none for empty repairs.

    A digest takes its bytes in order, so one task reads a conversation; it holds the digest only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, hashlib.sha256()
        for rows in _edited(batches):
            done = []
            for c, role, text, fresh in rows:
                if fresh:
                    if conv is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            yield _digest_batch(done)
        if conv is not None:
            yield _digest_batch([(conv, digest.hexdigest())])

    return _with_edits(turns, judged).mapInArrow(run, "conv string, sha256 string")


def _digest_batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["conv", "sha256"])


def repair_conversations(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered rows, judgement per conversation) of a table of conv_id, turn, role, text.

    Other columns are ignored. A null conv_id is a conversation. Rows that share a turn are
    ordered by role and text. `gaps` counts the turns missing between the first and the last.
    Feed both to `repaired_turns` for the repaired rows.
    """
    turns = ordered_turns(rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text"))
    span = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    return turns, settle(judge(turns).join(span, "conv"), spark, "judged")


def conversation_of(conv: Column, rows: DataFrame) -> Column:
    """The conv_id that a key stands for, in the type of the table."""
    return key_value(conv, rows.schema["conv_id"].dataType)
