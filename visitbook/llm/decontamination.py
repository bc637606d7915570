"""Benchmark decontamination: find test passages in training texts and cut them out.

The n-grams of the normalised benchmark words form a hash set that travels to the workers.
Each training text is scanned once; every hash hit is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitbook.llm import text_arrays as ta
from visitbook.session import settle

WINDOW = 10
# Windows held by one worker at a time (about 200 bytes each). A larger benchmark is split by
# hash into slices of this expected size, and the texts pass one slice after the other.
SLICE_WINDOWS = 1 << 18

HITS = "n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id") -> DataFrame:
    """One row per distinct window of the items: hash, n, gram (words joined by blanks), items."""

    def cut(batches):
        tables = ta.PowerTables(ta.BYTE_BASE), ta.PowerTables(ta.WORD_BASE)
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                data, bounds = ta.text_bytes(batch.column("text"))
                low, starts, ends, first = ta.words(data, bounds)
                text = low.tobytes()
                out = {"hash": [], "n": [], "gram": [], "item": []}
                ids = batch.column("item").to_pylist()
                hashes = ta.range_hashes(low.astype(np.uint64), starts, ends, tables[0])
                for r, item in enumerate(ids):
                    a, b = int(first[r]), int(first[r + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    at = np.arange(a, b - n + 1)
                    grams = ta.range_hashes(hashes, at, at + n, tables[1]).view(np.int64)
                    for i, h in zip(at.tolist(), grams.tolist(), strict=True):
                        out["hash"].append(h)
                        out["n"].append(n)
                        out["gram"].append(gram_at(text, starts, ends, i, n))
                        out["item"].append(item)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("hash", pa.int64()), ("n", pa.int32()), ("gram", pa.binary()), ("item", pa.string())
                ]))

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col("text").alias("text"))
    grams = items.mapInArrow(cut, "hash bigint, n int, gram binary, item string")
    # The same window in several items: the owners are at most the items of the benchmark.
    return grams.groupBy("hash", "n", "gram").agg(F.collect_set("item").alias("items"))


def gram_at(text: bytes, starts: np.ndarray, ends: np.ndarray, i: int, n: int) -> bytes:
    """The n words from word i on, joined by blanks."""
    return b" ".join([text[s:e] for s, e in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)])


class WindowSet:
    """Windows of a benchmark, looked up by the hashes of a text's windows."""

    def __init__(self, rows: list):
        self.by_hash: dict[int, list[tuple[bytes, list[str]]]] = {}
        lengths: dict[int, set[int]] = {}
        for row in rows:
            self.by_hash.setdefault(row["hash"], []).append((bytes(row["gram"]), row["items"]))
            lengths.setdefault(row["n"], set()).add(row["hash"])
        self.lengths = {n: np.array(sorted(h), np.int64) for n, h in lengths.items()}

    def find(self, text: bytes, starts, ends, first, hashes, tables) -> list[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of every verified occurrence."""
        found = []
        for n, known in self.lengths.items():
            at = ta.windows_in_rows(first, n)
            if not len(at):
                continue
            grams = ta.range_hashes(hashes, at, at + n, tables).view(np.int64)
            place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            for k in np.flatnonzero(known[place] == grams):
                i = int(at[k])
                gram = gram_at(text, starts, ends, i, n)
                for other, items in self.by_hash[int(grams[k])]:
                    if other == gram:
                        found.append((i, n, items))
        return found


def window_slices(benchmark: DataFrame, window: int, slice_windows: int, id_col: str) -> Iterator[WindowSet]:
    """The benchmark's windows in sets of bounded size, one after the other; written out first."""
    grams = settle(benchmark_windows(benchmark, window, id_col), benchmark.sparkSession, "windows")
    total = grams.count()
    parts = max(1, -(-total // slice_windows))
    part = F.pmod(F.xxhash64("hash"), F.lit(parts))
    for p in range(parts):
        yield WindowSet(grams.where(part == p).collect())


def scanned_but_for_last(docs: DataFrame, slices: Iterator[WindowSet]) -> tuple[DataFrame, WindowSet]:
    """`docs` with what all slices but the last have found, and the last one.

    Each slice's pass is written out before the next slice is fetched, so neither the driver nor
    a task holds more than one or two of them.
    """
    found = docs.withColumns(blank_hits())
    known = next(slices)
    for following in slices:
        found = settle(found.mapInArrow(scan(known), found.schema), docs.sparkSession, "hits")
        known = following
    return found, known


def scan(known: WindowSet):
    """Task function: adds what this set finds to each row's spans (in words) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ta.PowerTables(ta.BYTE_BASE), ta.PowerTables(ta.WORD_BASE)
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                data, bounds = ta.text_bytes(batch.column("text"))
                low, starts, ends, first = ta.words(data, bounds)
                hashes = ta.range_hashes(low.astype(np.uint64), starts, ends, tables[0])
                hits = known.find(low.tobytes(), starts, ends, first, hashes, tables[1])
                spans = [list(x or ()) for x in batch.column("spans").to_pylist()]
                items = [set(x or ()) for x in batch.column("items").to_pylist()]
                for i, n, owners in hits:
                    r = int(np.searchsorted(first, i, side="right")) - 1
                    spans[r].append({"start": i - int(first[r]), "end": i - int(first[r]) + n})
                    items[r].update(owners)
                new = {
                    "n_words": pa.array(np.diff(first), pa.int64()),
                    "spans": pa.array([merged(x) for x in spans], SPANS),
                    "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays(
                    [new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names
                )

    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def merged(spans: list[dict]) -> list[dict]:
    """Overlapping or touching spans as one, in order."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def blank_hits() -> dict[str, Column]:
    return {
        "n_words": F.lit(0).cast("bigint"),
        "spans": F.array().cast("array<struct<start: int, end: int>>"),
        "items": F.array().cast("array<string>"),
    }


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """The rows of `docs` with n_words, spans (word ranges inside occurring windows) and items.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is
    one window. Words compare with A-Z lower-cased. A null or empty text has no words and no
    hits; an empty benchmark hits nothing; equal rows are judged one by one. Columns of `docs`
    that are named like a result are replaced. No shuffle of the texts takes place.
    """
    found, last = scanned_but_for_last(docs, window_slices(benchmark, window, slice_windows, id_col))
    return found.mapInArrow(scan(last), found.schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
    slice_windows: int = SLICE_WINDOWS,
) -> DataFrame:
    """The columns of `docs`, with every benchmark passage cut out of `text`.

    A span is cut from its first word's first to its last word's last character. A text that
    has lost all its words goes; texts without a hit, null and empty ones included, stay as
    they are. `n_chars`, if there, is counted again for changed texts.
    """
    found, last = scanned_but_for_last(docs, window_slices(benchmark, window, slice_windows, id_col))
    schema = found.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                hit = [i for i, n in enumerate(batch.column("spans").value_lengths().to_pylist()) if n]
                if not hit:
                    yield batch
                    continue
                texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
                for i in hit:
                    texts[i], keep[i] = without_words(texts[i], batch.column("spans")[i].as_py())
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column("text").type)).filter(
                    pa.array(keep)
                )

    out = found.mapInArrow(lambda batches: cut(scan(last)(batches)), schema)
    if "n_chars" in docs.columns:
        changed = F.size("spans") > 0
        count = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def without_words(text: str, spans: list[dict]) -> tuple[str, bool]:
    """The text without the given word ranges, and whether a word is left."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, starts, ends, _ = ta.words(data, np.array([0, len(data)]))
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : starts[s["start"]]])
        at = int(ends[s["end"] - 1])
    kept.append(raw[at:])
    left = len(starts) - sum(s["end"] - s["start"] for s in spans)
    return b"".join(kept).decode(), left > 0
