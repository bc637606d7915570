"""Secret scans: fixed patterns, and strings that stay incompressible beside what surrounds them.

A candidate is a long token that follows a sensitive word. Its novelty is what it adds, in
compressed bytes, to its surrounding text when the compressor has been primed with identifiers
that recur in such places all over the corpus. Ordinary names and placeholders add little.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitbook.llm import text_arrays as ta

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

# Words that make a context sensitive, and what stands close behind them.
SENSITIVE_WORDS = (
    "password passwd passphrase passwort contraseña secret token api_key apikey api-key access_key access-key "
    "accesskey private_key private-key privatekey credential bearer authorization signature connectionstring"
).split() + ["api key", "access key", "private key", "connection string"]
SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE_WORDS)))
REACH = 80  # characters from the end of a sensitive word to the start of a candidate
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
# The next line of a key that is written over several: a whole line is one token. Line breaks may
# be escaped, as in JSON, and lines quoted, indented or commented.
NEXT_LINE = re.compile(
    r"""(?:[\x20\t"',;]{0,8}(?:\r\n?|\n|(?:\\r)?\\n)){1,2}[\x20\t"'>\#|*]{0,80}([A-Za-z0-9+/_=~.-]++)(?=[\x20\t"',;]{0,8}(?:[\r\n\\]|\Z))"""
)
KEY_END = re.compile(r"[\s\\rn\"'>\#|*]{0,80}-----END")
DIGIT, UPPER, LOWER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")
IDENTIFIER = re.compile(r"[A-Za-z_]{4,32}")
SURROUNDING = 256  # characters of text on either side
KEY = 16  # least length of the part by which a token is known again

# Identifiers in the dictionary (at most 32 characters each), and in how many texts they occur.
DICTIONARY_WORDS = 2000
DICTIONARY_TEXTS = 5
# A candidate is novel if it adds this many bytes per character, and this many in all.
NOVEL_SHARE, NOVEL_BYTES = 0.55, 10

RESULT = "secrets array<struct<kind: string, start: int, end: int>>"


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int

    def order(self) -> tuple[int, int, int]:
        return self.start, KINDS.index(self.kind), self.end


def base_spans(text: str, low: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= ASSIGN_LENGTH:
                found.append(Span("assign", *m.span()))
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def sensitive_places(text: str, low: str) -> list[int]:
    """Ends of sensitive words, as offsets into the text."""
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    if len(low) != len(text):  # lower-casing has moved the offsets
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return [m.end() for m in SENSITIVE.finditer(low)]


def mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) or token.lower() != token and token.upper() != token


def mixed_from(text: str, run: tuple[int, int]) -> int:
    """The last place of a run of token characters from which the rest of it is `mixed`, or -1."""
    token = text[run[0] : run[1]][::-1]
    first = [len(token) - 1 - m.start() if (m := r.search(token)) else -1 for r in (DIGIT, UPPER, LOWER)]
    last = max(first[0], min(first[1:]))
    return run[0] + last if last >= 0 else -1


def candidates(text: str, low: str) -> list[list[tuple[int, int]]]:
    """Long tokens that start within reach of a sensitive word, each with the lines that directly
    follow it; they must hold a digit or letters of both cases. No token is in two lists.

    Words may stand inside a token; then what follows the first and the last of them are tokens.
    All places and all tokens are gathered once, so the time grows with the text.
    """
    places = sensitive_places(text, low)
    if not places:
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    starts = [a for a, _ in runs]
    latest = [-2] * len(runs)  # filled when a run is met
    inside: dict[int, tuple[int, int]] = {}  # first and last word's end in a run
    first = set()

    def offer(i: int, start: int) -> None:
        if latest[i] == -2:
            latest[i] = mixed_from(text, runs[i])
        if start <= latest[i]:
            first.add((start, runs[i][1]))

    for place in places:
        i = bisect_right(starts, place) - 1
        if i >= 0 and starts[i] < place and runs[i][1] - place >= KEY:
            inside[i] = inside.get(i, (place, place))[0], place
        i += i < 0 or starts[i] < place
        while i < len(runs) and starts[i] - place <= REACH:
            offer(i, starts[i])
            i += 1
    for i, ends in inside.items():
        for place in ends:
            offer(i, place)
    found, following = [], set()
    for span in sorted(first):
        if span not in following:
            found.append([span, *next_lines(text, span, following)])
    return found


def next_lines(text: str, span: tuple[int, int], following: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The lines that carry a token on, up to one that is in `following`, to which they are added.
    A shorter last line belongs to a key if the two before are as long as one another, or if the
    key's end is marked.
    """
    before = 0
    while (m := NEXT_LINE.match(text, span[1])) and m.span(1) not in following:
        length = len(m[1])
        if length < KEY:
            if span[1] - span[0] == before >= length or KEY_END.match(text, m.end(1)):
                yield m.span(1)
            return
        if not mixed(m[1]):
            return
        before, span = span[1] - span[0], m.span(1)
        following.add(span)
        yield span


def pieces(token: str) -> list[str]:
    """The parts of a token by which its other places are told, the value behind a name last."""
    parts = [p.strip("+/_~.-") for p in token.split("=")]
    return [p for p in parts if len(p) >= KEY] or [token]


class Novelty:
    """Marginal compressed bytes of a candidate, beside surroundings without further copies of it."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False)

    def bytes_added(self, text: str, start: int, end: int, lines: list[tuple[int, int]] | None = None) -> int:
        copies = {p for a, b in lines or [(start, end)] for p in pieces(text[a:b])}
        more = SURROUNDING + max(map(len, copies))  # a copy may be cut by the end of the surroundings
        before, after = text[max(0, start - more) : start], text[end : end + more]
        for c in copies:
            before, after = before.replace(c, " " * len(c)), after.replace(c, " " * len(c))
        before, after = before[-SURROUNDING:], after[:SURROUNDING]
        without = len(self.compressor.compress((before + after).encode()))
        return len(self.compressor.compress((before + text[start:end] + after).encode())) - without

    def novel_lines(self, text: str, lines: list[tuple[int, int]]) -> bool:
        """Whether the lines are novel as a whole."""
        added = self.bytes_added(text, lines[0][0], lines[-1][1], lines)
        return added >= max(NOVEL_BYTES, NOVEL_SHARE * sum(end - start for start, end in lines))

    def novel(self, text: str, start: int, end: int) -> bool:
        return self.bytes_added(text, start, end) >= max(NOVEL_BYTES, NOVEL_SHARE * (end - start))


def find_secrets(text: str, novelty: Novelty) -> list[Span]:
    """All spans of a text, by start and kind. Lines of one key are judged each and as a whole. A
    string that is novel in one place is reported in all its places. Novel strings inside another
    span are not repeated.
    """
    low = text.lower()
    found = base_spans(text, low)
    keys: set[str] = set()
    known, short = [], []
    for lines in candidates(text, low):
        whole = len(lines) > 1 and novelty.novel_lines(text, lines)
        for start, end in lines:
            key = pieces(text[start:end])[-1]
            if whole or key not in keys and end - start >= KEY and novelty.novel(text, start, end):
                if len(key) >= KEY:
                    keys.add(key)
                else:
                    short.append((start, end))
            known.append((start, end, key))
    found += uncovered(short, found)
    if keys:
        found += uncovered([(start, end) for start, end, key in known if key in keys], found)
        found += uncovered(occurrences(text, keys), found)
    return sorted(found, key=Span.order)


def uncovered(places: Iterable[tuple[int, int]], found: list[Span]) -> list[Span]:
    """Novel spans of the places that lie inside none of the spans found."""
    order = sorted(found, key=Span.order)
    starts, reach = [s.start for s in order], list(accumulate((s.end for s in order), max))

    def covered(start: int, end: int) -> bool:
        i = bisect_right(starts, start) - 1
        return i >= 0 and reach[i] >= end

    return [Span("novel", start, end) for start, end in places if not covered(start, end)]


def occurrences(text: str, keys: set[str]) -> Iterator[tuple[int, int]]:
    """Places of the keys in the long tokens of a text, the longest key first."""
    heads: dict[str, dict[int, set[str]]] = {}
    for key in keys:
        heads.setdefault(key[:KEY], {}).setdefault(len(key), set()).add(key)
    for run in CANDIDATE.finditer(text):
        at = run.start()
        while at <= run.end() - KEY:
            lengths = heads.get(text[at : at + KEY], {})
            n = max((n for n, same in lengths.items() if text[at : at + n] in same), default=0)
            if n:
                yield at, at + n
            at += max(1, n)


def sensitive_stretches(text: str) -> list[tuple[int, int]]:
    """The surroundings of all sensitive words, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for place in sensitive_places(text, text.lower()):
        a, b = max(0, place - SURROUNDING), min(len(text), place + SURROUNDING)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def identifier_dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS, texts: int = DICTIONARY_TEXTS) -> bytes:
    """Identifiers around sensitive words in at least `texts` texts, the most frequent last.

    Every text is counted, texts whose sensitive surroundings are the same as one. Nothing is
    counted that lies inside a token which could be a candidate: the dictionary must not hold
    the secrets. It has at most `words` entries of 32 characters, the last of which a compressor
    reaches at the lowest cost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[bytes] = []
            found: list[list[str]] = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                stretches = sensitive_stretches(text)
                if not stretches:
                    continue
                hashes.append(hashlib.blake2b("\0".join(text[a:b] for a, b in stretches).encode(), digest_size=16).digest())
                plain = CANDIDATE.sub(lambda m: " " * len(m[0]) if mixed(m[0]) else m[0], text)
                found.append(sorted({w for a, b in stretches for w in IDENTIFIER.findall(plain, a, b)}))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=["surroundings", "words"]
            )

    around = docs.select("text").mapInArrow(run, "surroundings binary, words array<string>")
    distinct = around.dropDuplicates(["surroundings"])
    counts = distinct.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= texts).orderBy(F.desc("n"), "word").limit(words).collect()
    return "\n".join(r["word"] for r in reversed(top)).encode()


def scan_secrets(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """The rows of `docs` with `secrets`: kind, start and end (code points) of every span.

    Base kinds are always reported; the kind `novel` comes from the compressor. A null or
    empty text has none; equal rows are scanned one by one. A column named secrets is replaced.
    Without a dictionary one is gathered from `docs` first.
    """
    primed = identifier_dictionary(docs) if dictionary is None else dictionary
    blank = with_blank(docs)
    return blank.mapInArrow(scan(primed), blank.schema)


def with_blank(docs: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    return docs.drop("secrets").withColumn("secrets", none)


def scan(primed: bytes):
    """Task function: fills each row's `secrets`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        for batch in batches:
            spans = [
                [{"kind": s.kind, "start": s.start, "end": s.end} for s in find_secrets(t.as_py() or "", novelty)]
                for t in batch.column("text")
            ]
            at = batch.schema.get_field_index("secrets")
            yield batch.set_column(at, "secrets", pa.array(spans, SPANS))

    return run


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def redact(docs: DataFrame, mark: str = "[secret]", dictionary: bytes | None = None) -> DataFrame:
    """The columns of `docs`, with every span replaced by `mark`; overlapping spans give one.

    Texts without secrets, null and empty ones included, stay as they are. `n_chars`, if
    there, is counted again for changed texts.
    """
    primed = identifier_dictionary(docs) if dictionary is None else dictionary
    # Of a clashing column only the name is set aside.
    own = docs.withColumnRenamed("secrets", "own secrets")
    found = with_blank(own)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                sizes = np.asarray(batch.column("secrets").value_lengths().fill_null(0))
                if not sizes.any():
                    yield batch
                    continue
                texts = batch.column("text").to_pylist()
                for i in np.flatnonzero(sizes):
                    texts[i] = marked(texts[i], batch.column("secrets")[int(i)].as_py(), mark)
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column("text").type))

    out = found.mapInArrow(lambda batches: replace(scan(primed)(batches)), found.schema)
    if "n_chars" in docs.columns:
        count = F.when(F.size("secrets") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.select(own.columns).withColumnRenamed("own secrets", "secrets")


def marked(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for s in spans:  # by start
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])
