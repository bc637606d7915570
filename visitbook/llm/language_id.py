"""Language identification with interpolated Kneser-Ney character models.

Words are runs of letters, lower-cased and closed by boundary symbols. One model per language
is fitted on a bounded sample; the n-grams of all languages share one sorted hash array per
order, with a column of weights per language. The language of the lowest cross-entropy per
symbol wins, and a text far above what its language's own texts show is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitbook.llm import text_arrays as ta

ORDER = 5
# Bound of the training sample: documents per language, chosen by a hash of their id.
SAMPLE_DOCS, SAMPLE_PARTS = 300, 64
# One sampled document in this many calibrates the rejection instead of training.
CALIBRATION_SHARE = 5
# Standard errors, and bits per symbol beyond them, that a text may lie above its language's mean.
REJECT_ERRORS, REJECT_BITS = 8.0, 1.0
# Distinct words whose scores a task remembers, and that it scores at a time.
CACHED_WORDS, SCORED_WORDS = 1 << 18, 1 << 14
BEGIN, END = 2, 3  # control characters: never letters
UNKNOWN = "und"

RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


@cache
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@dataclass
class WordList:
    """Words as one array of symbols, each word between BEGIN and END."""

    symbols: np.ndarray
    starts: np.ndarray  # place of each BEGIN
    sizes: np.ndarray  # symbols to predict: letters and END

    @classmethod
    def of(cls, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> WordList:
        sizes = ends - starts
        at = np.cumsum(sizes + 2) - (sizes + 2)
        symbols = np.full(int((sizes + 2).sum()), END, np.uint64)
        symbols[at] = BEGIN
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols[np.repeat(at + 1, sizes) + inner] = letters[np.repeat(starts, sizes) + inner]
        return cls(symbols, at, sizes + 1)

    def depth(self) -> np.ndarray:
        """Per symbol its place in its word, 0 for BEGIN."""
        return np.arange(len(self.symbols)) - np.repeat(self.starts, self.sizes + 1)


def suffix_hashes(symbols: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n = 1 .. order, per place the hash of the n symbols that end there."""
    total, power = np.zeros(len(symbols), np.uint64), 1
    for n in range(order):
        total[n:] += (symbols[: len(symbols) - n] if n else symbols) * np.uint64(power)
        yield ta.mix(total + np.uint64(n + 1))
        power = power * ta.BYTE_BASE % (1 << 64)


@dataclass
class Grams:
    """The n-grams of one order: sorted hashes, direct weights and weights of what follows."""

    keys: np.ndarray
    direct: np.ndarray  # [gram, language] discounted share within its context
    onward: np.ndarray  # [gram, language] weight of the shorter context when this gram is the context


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))  # probability before any letter is known
    orders: list[Grams] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibrated bits per symbol
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))  # and their standard deviation

    def word_bits(self, words: WordList) -> np.ndarray:
        """[word, language] bits of each word."""
        n_symbols, depth = len(words.symbols), words.depth()
        p = np.tile(self.base, (n_symbols, 1))
        before = np.full(n_symbols, -1)
        for n, (grams, h) in enumerate(zip(self.orders, suffix_hashes(words.symbols, len(self.orders)), strict=True), 1):
            if n == 1:
                ask = np.arange(n_symbols)
            else:  # a seen gram's context and ending have been seen
                context = np.concatenate([[-1], before[:-1]])
                ask = np.flatnonzero((depth >= n - 1) & (context >= 0))
                p[ask] *= grams_before.onward[context[ask]]
                ask = ask[before[ask] >= 0]
            place = np.minimum(np.searchsorted(grams.keys, h[ask]), len(grams.keys) - 1)
            hit = grams.keys[place] == h[ask]
            before = np.full(n_symbols, -1)
            before[ask[hit]] = place[hit]
            p[ask[hit]] += grams.direct[place[hit]]
            grams_before = grams
        bits = -np.log2(p)
        bits[words.starts] = 0  # BEGIN is given
        return np.add.reduceat(bits, words.starts, axis=0)


def fit_language(words: WordList, counts: np.ndarray, order: int) -> tuple[float, list[tuple[np.ndarray, ...]]]:
    """Interpolated Kneser-Ney of one language.

    Returns the weight before order 1, and per order the keys, direct and onward weights.
    Lower orders count the different symbols seen before a gram; grams that begin a word, which
    have nothing before them, count their occurrences.
    """
    depth, weight = words.depth(), np.repeat(counts, words.sizes + 1).astype(float)
    hashes = list(suffix_hashes(words.symbols, order))
    kinds = []  # per order: keys, first place, occurrences
    for n, h in enumerate(hashes, 1):
        at = np.flatnonzero(depth >= n - 1)
        keys, place, inverse = np.unique(h[at], return_index=True, return_inverse=True)
        kinds.append((keys, at[place], np.bincount(inverse, weight[at], len(keys))))
    out, first = [], 0.0
    onward_next: list[tuple[np.ndarray, np.ndarray]] = []
    for n, (keys, place, seen) in enumerate(kinds, 1):
        if n < order:
            longer = kinds[n][1]  # one place for each different gram of the next order
            continued = np.bincount(np.searchsorted(keys, hashes[n - 1][longer]), minlength=len(keys)).astype(float)
            used = np.where(depth[place] == n - 1, seen, continued)
        else:
            used = seen
        predicted = depth[place] > 0  # BEGIN itself is never predicted
        once, twice = (used[predicted] == 1).sum(), (used[predicted] == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        if n == 1:
            context, groups = np.zeros(len(keys), np.int64), 1
        else:
            context, groups = np.searchsorted(kinds[n - 2][0], hashes[n - 2][place - 1]), len(kinds[n - 2][0])
        used = np.where(predicted, used, 0.0)
        totals = np.bincount(context, used, groups)
        types = np.bincount(context, used > 0, groups)
        onward = np.where(totals > 0, discount * types / np.maximum(totals, 1), 1.0)
        direct = np.where(predicted, np.maximum(used - discount, 0) / np.maximum(totals, 1)[context], 0.0)
        if n == 1:
            first = float(onward[0])
        else:
            onward_next.append((kinds[n - 2][0], onward))
        out.append((keys, direct))
    onward_next.append((kinds[-1][0], np.ones(len(kinds[-1][0]))))
    return first, [(k, d, o) for (k, d), (_, o) in zip(out, onward_next, strict=True)]


def fit(words_by_language: dict[str, Counter], order: int = ORDER) -> Model:
    """Models of all languages over one set of n-grams per order."""
    languages = sorted(words_by_language)
    parts, symbols = [], set()
    for lang in languages:
        words = sorted(words_by_language[lang])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum([len(w) for w in words])
        symbols.update(np.unique(letters).tolist())
        listed = WordList.of(letters, np.concatenate([[0], ends[:-1]]), ends)
        parts.append(fit_language(listed, np.array([words_by_language[lang][w] for w in words]), order))
    model = Model(languages, np.array([first for first, _ in parts]) / (len(symbols) + 2))
    for n in range(order):
        keys = np.unique(np.concatenate([p[n][0] for _, p in parts])) if parts else np.zeros(0, np.uint64)
        direct = np.zeros((len(keys), len(languages)), np.float32)
        onward = np.ones((len(keys), len(languages)), np.float32)
        for k, (_, p) in enumerate(parts):
            at = np.searchsorted(keys, p[n][0])
            direct[at, k], onward[at, k] = p[n][1], p[n][2]
        model.orders.append(Grams(keys, direct, onward))
    return model


class TextScorer:
    """Bits and symbols of whole texts; the scores of words are remembered."""

    def __init__(self, model: Model):
        self.model, self.tables = model, ta.PowerTables(ta.BYTE_BASE)
        self.keys, self.bits = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the bits under each language, and the number of symbols (0: no letter)."""
        low = [(t or "").lower() for t in texts]
        letters = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in low])])
        starts, ends, first = ta.token_bounds(letter_table()[letters], bounds)
        total, symbols = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        if len(starts) and self.model.languages:
            wide = letters.astype(np.uint64)
            h = ta.range_hashes(wide, starts, ends, self.tables)
            keys, place, inverse = np.unique(h, return_index=True, return_inverse=True)
            per_word = self.scores(keys, wide, starts[place], ends[place])[inverse]
            filled = np.flatnonzero(np.diff(first))
            total[filled] = np.add.reduceat(per_word, first[filled], axis=0)
        sizes = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        return total, np.diff(sizes[first]) if len(starts) else symbols

    def scores(self, keys: np.ndarray, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[at] != keys)
        else:
            at, new = np.zeros(len(keys), np.int64), np.arange(len(keys))
        out = np.empty((len(keys), len(self.model.languages)))
        known = np.ones(len(keys), bool)
        known[new] = False
        out[known] = self.bits[at[known]]
        if len(new):
            for part in np.array_split(new, -(-len(new) // SCORED_WORDS)):
                out[part] = self.model.word_bits(WordList.of(letters, starts[part], ends[part]))
            if len(self.keys) + len(new) > CACHED_WORDS:
                self.keys, self.bits = keys[:0], out[:0]
            joined = np.concatenate([self.keys, keys[new]])
            order = np.argsort(joined)
            self.keys, self.bits = joined[order], np.concatenate([self.bits, out[new]])[order]
        return out


def sample(docs: DataFrame, per_language: int, seed_col: Column) -> DataFrame:
    """At most `per_language` documents of each language: lang, text. Documents without a
    language or without an id are not drawn.
    """
    usable = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    order = [seed_col, F.col("doc_id")]

    def first(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("rank", rank).where(F.col("rank") <= per_language)

    # A language may hold most rows: its parts are cut to the wanted number before they meet.
    parts = first(usable.select("doc_id", "lang", F.pmod(seed_col, F.lit(SAMPLE_PARTS)).alias("part")), "lang", "part")
    chosen = first(parts.select("doc_id", "lang"), "lang")
    picked = usable.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    return first(picked, "lang")  # an id may repeat


def train(docs: DataFrame, order: int = ORDER, per_language: int = SAMPLE_DOCS) -> Model:
    """Fit on text and lang of at most `per_language` of the given documents per language.

    The words are counted by the executors; what reaches the driver, the model and its
    calibration figures, is bounded by the sample. No labelled document gives no language.
    """
    seed = F.xxhash64("doc_id", F.lit("language sample"))
    drawn = sample(docs, per_language, seed)
    calibrating = F.col("rank") % CALIBRATION_SHARE == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = Counter(letter_runs(text or ""))
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(n), "word": list(n), "n": list(n.values())}, WORD_ROWS)

    rows = drawn.where(~calibrating).mapInArrow(count, "lang string, word string, n bigint")
    words: dict[str, Counter] = {}
    for r in rows.groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        words.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    model = fit(words, order)
    calibrate(model, drawn.where(calibrating))
    return model


WORD_ROWS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def letter_runs(text: str) -> list[str]:
    low = text.lower()
    return "".join(c if c.isalpha() else " " for c in low).split()


def calibrate(model: Model, drawn: DataFrame) -> None:
    """Mean bits per symbol, and spread around it per square root of a symbol, of each language."""
    n = len(model.languages)
    model.mean, model.spread = np.zeros(n), np.zeros(n)
    if not n:
        return

    shared = drawn.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = TextScorer(model)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            bits, symbols = scorer(batch.column("text").to_pylist())
            rows = [(lang, float(bits[i, model.languages.index(lang)]), int(symbols[i])) for i, lang in enumerate(langs)
                    if symbols[i] and lang in model.languages]
            yield pa.RecordBatch.from_pydict(
                {"lang": [r[0] for r in rows], "bits": [r[1] for r in rows], "n": [r[2] for r in rows]},
                pa.schema([("lang", pa.string()), ("bits", pa.float64()), ("n", pa.int64())]),
            )

    rows = drawn.mapInArrow(measure, "lang string, bits double, n bigint")
    sums = rows.groupBy("lang").agg(
        F.sum("bits").alias("bits"), F.sum("n").alias("n"),
        F.sum(F.col("bits") * F.col("bits") / F.col("n")).alias("squares"), F.count("*").alias("docs"),
    )
    for r in sums.collect():
        k = model.languages.index(r["lang"])
        model.mean[k] = r["bits"] / r["n"]
        # n * (bits / n - mean)**2 averages to the variance of one symbol's bits
        model.spread[k] = max(0.0, r["squares"] - r["bits"] ** 2 / r["n"]) ** 0.5 / max(1, r["docs"] - 1) ** 0.5
    shared.destroy()
    # A language of too few documents to be calibrated takes the loosest bound of the others.
    unseen = model.mean == 0
    model.mean[unseen] = model.mean.max() if not unseen.all() else np.inf
    model.spread[unseen] = model.spread.max()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` with lang_pred, score, cross_entropy and rejected.

    `lang_pred` is the language of the lowest cross-entropy per symbol (ties: the first by
    name), `und` if the text is null or has no letter or no language was learned; `score` is
    its share of 2**-cross_entropy over all languages, 0 for `und`. `rejected` is true for
    `und` and for texts too far above the calibrated cross-entropy. Columns of `docs` that are
    named like a result are replaced. One scan, no shuffle.
    """
    results = [c.split()[0] for c in RESULT.split(", ")]
    kept = docs.drop(*results)
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema] + [RESULT])

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = TextScorer(model)
        for whole in batches:
            for batch in ta.slices(whole, "text"):
                bits, symbols = scorer(batch.column("text").to_pylist())
                columns = verdicts(model, bits, symbols)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *columns], names=[*batch.schema.names, *results]
                )

    return kept.mapInArrow(run, schema)


def verdicts(model: Model, bits: np.ndarray, symbols: np.ndarray) -> list[pa.Array]:
    known = (symbols > 0) & bool(model.languages)
    per_symbol = bits / np.maximum(symbols, 1)[:, None]
    if model.languages:
        best = np.argmin(per_symbol, axis=1)
        lowest = per_symbol[np.arange(len(best)), best]
        score = 1 / np.exp2(lowest[:, None] - per_symbol).sum(axis=1)
        bound = model.mean[best] + REJECT_BITS + REJECT_ERRORS * model.spread[best] / np.sqrt(np.maximum(symbols, 1))
        names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    else:
        lowest = score = np.zeros(len(symbols))
        bound, names = lowest, [UNKNOWN] * len(symbols)
    return [
        pa.array(names, pa.string()),
        pa.array(np.where(known, score, 0.0), pa.float64()),
        pa.array(lowest, pa.float64(), mask=~known),
        pa.array(~known | (lowest > bound), pa.bool_()),
    ]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
