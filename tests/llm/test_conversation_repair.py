from __future__ import annotations

import hashlib
import itertools
import re
import zlib

from conftest import plan
from pyspark.sql import functions as F

from visitbook.llm import conversation_repair as cr
from visitbook.llm import queries
from visitbook.llm import role_grammar as g

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """Every edit sequence of few rows, tried out: the cheapest, ties ASCII-least."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for n in range(3):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                audit, cost = "", 5 * n
                for i in range(len(rows) + 1):
                    audit += "I" * places.count(i)
                    audit += edits[i] if i < len(rows) else ""
                for (_, fault), e in zip(rows, edits, strict=True):
                    cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and fault == g.CUT_OFF else 0)
                    if e != "D" and fault in (g.BLANK, g.REPEATED):
                        cost = 10**9
                kept = [r for (r, _), e in zip(rows, edits, strict=True)]
                for free in itertools.product("ua", repeat=sum(c in "IR" for c in audit)):
                    given, at, roles = iter(free), iter(kept), ""
                    for e in audit:
                        r = next(at) if e != "I" else ""
                        roles += r if e == "K" else next(given) if e in "IR" else ""
                    if LEGAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


def test_repair_equals_exhaustive_search():
    letters = [(r, f) for r in "sua?" for f in (g.SOUND, g.CUT_OFF, g.BLANK)]
    for n in range(3):
        for rows in itertools.product(letters, repeat=n):
            assert g.repair("".join(g.row_code(*r) for r in rows)) == exhaustive(rows)
    for roles in itertools.product("sua", repeat=4):
        rows = [(r, g.CUT_OFF if i == 2 else g.SOUND) for i, r in enumerate(roles)]
        assert g.repair("".join(g.row_code(*r) for r in rows)) == exhaustive(rows)


def test_chunks_join_to_the_whole():
    codes = "".join(g.row_code("sua?"[i * 7 % 4], (i * i // 3) % 4) for i in range(300))
    ways = {g.BOTTOM: (0, "")}
    for cut in range(0, 300, 37):
        steps = [{g.STACKS.index(to): w for to, w in reached.items()} for reached in g.transfers(codes[cut : cut + 37])]
        ways = g.joined(ways, steps)
    assert g.finish(ways) == g.repair(codes)


# --- the whole query against a plain version ---------------------------------------------------


def shortest(rows):
    """The same by a table over rows and the roles' automaton."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    inserted = lambda ways: min_merge(ways, [
        (step[s, r], (c + 5, a + "I")) for s, (c, a) in ways.items() for r in "ua" if (s, r) in step])
    ways = {"": (0, "")}
    for initial, fault in rows:
        for _ in range(4):
            ways = inserted(ways)
        to = []
        for s, (c, a) in ways.items():
            to.append((s, (c + 2, a + "D")))
            if fault in ("blank", "duplicate"):
                continue
            cut = 5 * (fault == "truncated")
            if (s, initial) in step:
                to.append((step[s, initial], (c + cut, a + "K")))
            to += [(step[s, r], (c + cut + 1, a + "R")) for r in "ua" if (s, r) in step]
        ways = min_merge({}, to)
    for _ in range(4):
        ways = inserted(ways)
    return min(w for s, w in ways.items() if s in ("", "a"))


def min_merge(ways, offers):
    out = dict(ways)
    for s, w in offers:
        if s not in out or w < out[s]:
            out[s] = w
    return out


def brute(rows):
    show = lambda v: " " if v is None else str(v)
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = show(role), show(text)
            kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks, seen = [], set()
        for _, role, text in kept:
            solid = re.findall("[^\x20\x09-\x0d]", text)
            fault = ("blank" if not solid else "duplicate" if (role, text) in seen
                     else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
            marks.append((role[:1], fault))
        cost, audit = shortest(marks)
        repaired, before, at = [], "", iter(kept)
        for e in audit:
            _, role, text = next(at) if e != "I" else (None, "", "")
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if before == "u" else "user"
            before = role[:1]
            repaired.append(f"{role}:{text}")
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [f for _, f in marks]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(marks))
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    illegal, cost, audit, digest))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.op13_conversation_repair(spark, str(tmp_path))
    assert df.columns == COLUMNS
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_query_equals_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        found = queries.op13_conversation_repair(spark, f"/root/testdata/{sf}").collect()
        assert sorted([tuple(r) for r in found], key=repr) == brute(rows)


AWKWARD = [
    (1, None, "user", "No turn."), (1, None, "user", "Another one"), (1, 2, None, "Null role."), (1, 2, "user", None),
    (None, 1, "user", "Hello?"), (None, 2, "assistant", "Yes \t\n"), (None, None, None, None), (2, 5, "", "x"),
    (3, 0, "system", "S."), (3, 0, "system", "S."), (3, 1, "user", ""), (4, 7, "assistant", "é!"), (4, 7, "Übung", "ü."),
    (5, 1, "user", "x" * 300_000), (6, 10**15, "user", "far."), (6, -4, "assistant", "near."),
]


def test_awkward_rows(spark, tmp_path):
    assert run(spark, AWKWARD, tmp_path) == brute(AWKWARD)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert run(spark, [], tmp_path / "a") == []
    names = SCHEMA + ", row bigint, conv string, audit string, kind int"
    rows = [(*r, 1, "c", "a", 2) for r in AWKWARD[:8]]
    (tmp_path / "b").mkdir()
    assert run(spark, rows, tmp_path / "b", names) == brute(AWKWARD[:8])


def test_every_row_dropped(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(lost, 1, "user", "Gone.")], tmp_path) == [(lost, 0, 0, 0, 0, 0, 0, "", empty)]


def test_hot_conversation_spans_chunks_and_partitions(spark, tmp_path):
    rows = [(1, i, "user" if i % 2 else "assistant", f"Text {i % 900}." if i % 11 else "cut off") for i in range(10_000)]
    rows += [(2, i, "user", "Again.") for i in range(3)]
    assert run(spark, rows, tmp_path) == brute(rows)
    ordered = cr.ordered_turns(spark.read.parquet(f"{tmp_path}/conversations.parquet").repartition(4))
    chunks = cr.chunk_letters(ordered.withColumn("fault", F.lit(0))).where("conv = '=1'").count()
    assert chunks > 2


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (2, 0, "assistant", " ")]
    turns, judged = cr.repair_conversations(spark, spark.createDataFrame(rows, SCHEMA))
    found = cr.repaired_turns(turns, judged).orderBy("conv", "place").collect()
    assert [tuple(r) for r in found] == [("=1", 0, "user", "B."), ("=1", 1, "assistant", "C.")]
    assert {r["conv"]: r["audit"] for r in judged.collect()} == {"=1": "DKK", "=2": "D"}


def test_plan_has_no_theta_join(spark):
    text = plan(queries.op13_conversation_repair(spark, SF), "simple")
    assert "CartesianProduct" not in text and "NestedLoop" not in text
