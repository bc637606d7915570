"""Main text of web pages: a tree-structured graphical model over the blocks of a page.

Every node of a page's tree has one of three labels: MAIN (the article or a part of it), REST (none
of its text belongs to the article), FRAME (it holds the article and other things). Node potentials come from what a node is called and what its
text looks like, edge potentials join the labels of parent and child, and both are estimated from
labelled pages. Sum-product messages upward and downward give each text's probability of MAIN.

Two kinds of labelled pages train the model: pages made here from names that authors give to the
parts of a page, and pages of the corpus whose markup says where the article is.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.llm import text_arrays as ta
from visitbook.llm.page_tree import Page
from visitbook.session import settle

FRAME, MAIN, REST = range(3)
# Pages of the corpus the model is fitted on, the lowest by a hash; a documented bound.
LABELLED_PAGES = 2000
# What each count starts from, so that nothing is impossible: tags and looks, names, labels of a child.
FEATURE_PRIOR, NAME_PRIOR, EDGE_PRIOR = 0.5, 0.02, 0.02
THRESHOLD = 0.5

# Names that authors give to the parts of a page.
REST_NAMES = (
    "nav navbar navigation menu topbar breadcrumb breadcrumbs header masthead banner footer bottom copyright "
    "sidebar aside rail widget related recommended trending popular more share sharing social follow tags pagination "
    "pager comments comment disqus respond replies reply discussion reviews cookie cookies consent gdpr privacy notice "
    "alert message popup modal overlay newsletter subscribe subscription signup login register search ad ads advert "
    "adverts advertisement advertising adsense sponsor sponsored promo promoted promotion outbrain taboola skip "
    "toolbar contentinfo complementary dialog"
).split()
MAIN_NAMES = "article content main post entry story body text copy prose article-body post-content entry-content".split()
FRAME_NAMES = "wrapper container page site layout row col column inner outer grid root app wrap".split()
REST_TAGS = ("div", "section", "aside", "nav", "footer", "header", "form", "div")

SENTENCE = "This is one of the sentences that people write when they have something to tell to others, {}."


class Model(NamedTuple):
    features: dict[str, int]
    weights: np.ndarray  # [feature, label] log P(feature | label)
    root: np.ndarray     # [label] log P(label of the root)
    edges: np.ndarray    # [kind of child (element, text), parent label, child label] log P


def features(page: Page, node: int) -> list[str]:
    """What is seen of a node: the names and the tag of an element; the look of a text."""
    text = page.texts[node]
    if text is None:
        return ["tag " + page.tags[node], *("name " + n for n in sorted(set(page.names[node])))]
    words = text.count(" ") + 1
    size = sum(words >= n for n in (3, 7, 16, 40))
    link = page.links[node]
    linked = 0 if link == 0 else 1 if link < 0.5 else 2
    ended = text[-1] in ".!?…:;\"'”’»)。！？"
    return [f"size {size} {linked} {ended:d}"]


# --- labelled pages -----------------------------------------------------------------------


def made_pages() -> Iterator[str]:
    """Labelled pages: what lies in an element marked data-main is the article, but for data-rest."""
    sentence = lambda n: " ".join(SENTENCE.format(i) for i in range(n))

    def rest(k: int, mark: str = "") -> str:
        name, tag = REST_NAMES[k % len(REST_NAMES)], REST_TAGS[k % len(REST_TAGS)]
        links = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(3 + k % 3))
        inside = [
            f"<ul>{links}</ul>", f"<p>{sentence(1 + k % 4)}</p>", f"Short words {k}", f"<a href='/'>Read more</a> of {k}",
            f"<h3>Title {k}</h3><div><p>{sentence(2)}</p><p>{sentence(1)}</p></div>",
            "<label>Your name</label><p>Send it</p>", f"<p>{sentence(1)}</p><ul>{links}</ul>",
            f"<h1>Site {k}</h1><ul>{links}</ul>", f"{sentence(1 + k % 5)}", f"<h2>Part {k}</h2><p>{sentence(4)}</p>",
        ]
        return f'<{tag} class="{name}"{mark}>{inside[k % len(inside)]}</{tag}>'

    for k in range(2 * len(REST_NAMES)):
        tag, name = ("div", "article", "main", "section", "td")[k % 5], MAIN_NAMES[k % len(MAIN_NAMES)]
        points = "".join(f"<li>{p}</li>" for p in ("First thing", sentence(1), "Second thing, too", "Third thing of them"))
        cells = "".join(f"<tr><th>Kind {i}</th><td>{i * k}</td><td>some words</td></tr>" for i in range(3))
        body = [
            f"<h1>Title of {k}</h1>", f"<p>{sentence(3)}</p>", f"<p>{sentence(1 + k % 3)}</p>",
            f"<{'uo'[k % 2]}l>{points}</{'uo'[k % 2]}l>", f"<h2>Part {k}</h2><p>{sentence(2)}</p>",
            (f"<blockquote>{sentence(1)}</blockquote>", "<pre>x = 1</pre>", f"<table>{cells}</table>",
             f"<header><h1>Title {k}</h1><p>By someone</p></header>", f"<div><p>{sentence(1)}</p></div>",
             f"<figure><figcaption>{sentence(1)}</figcaption></figure>", f"<section>{sentence(1)}</section>")[k % 7],
            rest(k + 3, " data-rest") if k % 4 == 1 else "", f"<p>{sentence(2)}</p>", "<p>Yes.</p>" if k % 3 == 0 else "",
        ]
        around = f"<tr><td>{rest(k + 1)}</td>" if tag == "td" else rest(k + 1)
        main = f'<{tag} class="{name}" data-main>{"".join(body)}</{tag}>'
        if k % 9 == 0:  # no name tells the article
            main = f"<div data-main>{''.join(body)}</div>"
        inner = f"{rest(k)}{around}{main}{rest(k + 2)}{rest(k + 5)}"
        frame = FRAME_NAMES[k % len(FRAME_NAMES)]
        yield f'<html><body><div class="{frame}">{inner}</div>{rest(k + 7)}</body></html>'


def _made_part(page: Page, node: int) -> int | None:
    mark = page.attributes[node]
    return REST if "data-rest" in mark else MAIN if "data-main" in mark else None


def _named_part(page: Page, node: int) -> int | None:
    tag = page.tags[node]
    return MAIN if tag in ("article", "main") else REST if tag in ("nav", "aside", "footer", "form") else None


def labels(page: Page, part: Callable[[Page, int], int | None]) -> list[int | None] | None:
    """Labels of all nodes, given which elements begin or end the article; none for nodes without text.

    A page that has no article, or several, is not labelled.
    """
    n = len(page.tags)
    inside, marked = [REST] * n, 0
    for i in range(1, n):
        above, told = inside[page.parents[i]], part(page, i)
        marked += told == MAIN and above == REST
        inside[i] = above if told is None else told
    if marked != 1:
        return None
    main, rest = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.texts[i] is not None:
            main[i], rest[i] = inside[i] == MAIN, inside[i] == REST
        main[page.parents[i]] += main[i]
        rest[page.parents[i]] += rest[i]
    return [
        None if not m + r else REST if not m else FRAME if r and told == REST else MAIN
        for m, r, told in zip(main, rest, inside, strict=True)
    ]


def count_page(page: Page, part: Callable[[Page, int], int | None]) -> Counter[str]:
    """How often each feature and each child label goes with a label; empty for an unlabelled page."""
    counts: Counter[str] = Counter()
    told = labels(page, part)
    if not told or told[0] is None:
        return counts
    counts["pages"] = 1
    counts[f"root\t{told[0]}"] += 1
    for i in range(1, len(told)):
        if told[i] is None:
            continue
        counts[f"edge\t{int(page.texts[i] is not None)}\t{told[page.parents[i]]}\t{told[i]}"] += 1
        for f in features(page, i):
            counts[f"feature\t{f}\t{told[i]}"] += 1
    return counts


def _corpus_counts(pages: DataFrame, limit: int) -> dict[str, float]:
    """Counts over at most `limit` different pages whose markup names the article.

    Pages are the lowest by a hash of their text; copies are one. Only the hashes of the sample
    and counts of what occurs in it reach the driver.
    """
    hashed = pages.select("html", F.xxhash64("html").alias("h")).where("html IS NOT NULL")
    lowest = hashed.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if lowest is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("html"):
                counts += count_page(Page(text.as_py()), _named_part)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])

    sample = hashed.where(F.col("h") <= lowest).groupBy("h").agg(F.any_value("html").alias("html")).select("html")
    counted = sample.mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: float(r["n"]) for r in counted.collect()}


def train(pages: DataFrame, limit: int = LABELLED_PAGES) -> Model:
    """Fit the potentials on the made pages and on pages of the corpus, both kinds weighing alike.

    `pages` has html; a corpus without labelled pages leaves the made ones.
    """
    made: Counter[str] = Counter()
    for source in made_pages():
        made += count_page(Page(source), _made_part)
    found = _corpus_counts(pages, limit)
    scale = made["pages"] / found["pages"] if found.get("pages") else 0.0
    total = {k: made.get(k, 0) + scale * found.get(k, 0.0) for k in {*made, *found}}

    kinds = sorted({k.split("\t")[1] for k in total if k.startswith("feature")})
    numbers = {f: i for i, f in enumerate(kinds)}
    groups = np.array([f.split(" ")[0] for f in kinds])
    weights = np.where(groups == "name", NAME_PRIOR, FEATURE_PRIOR)[:, None].repeat(3, axis=1)
    root, edges = np.full(3, EDGE_PRIOR), np.full((2, 3, 3), EDGE_PRIOR)
    for key, n in total.items():
        kind, *rest = key.split("\t")
        if kind == "feature":
            weights[numbers[rest[0]], int(rest[1])] += n
        elif kind == "root":
            root[int(rest[0])] += n
        elif kind == "edge":
            edges[tuple(map(int, rest))] += n
    edges[1, :, FRAME] = 1e-30  # a text is of the article or not
    # A node has one tag and a text one look; of names it may have several, each drawn by itself.
    for g in set(groups):
        weights[groups == g] /= weights[groups == g].sum(axis=0)
    return Model(numbers, np.log(weights), np.log(root / root.sum()), np.log(edges / edges.sum(axis=2, keepdims=True)))


# --- inference ----------------------------------------------------------------------------


def _log_sum(values: np.ndarray) -> np.ndarray:
    """log(sum(exp)) over the last axis."""
    top = values.max(axis=-1, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=-1)) + top[..., 0]


def marginals(parents: np.ndarray, is_text: np.ndarray, potentials: np.ndarray, model: Model) -> np.ndarray:
    """[node, label] probability of every label, for trees whose parents stand before their children.

    Messages go up level by level from the deepest nodes, then down again.
    """
    n = len(parents)
    depth = np.zeros(n, np.int64)
    for i, p in enumerate(parents.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if n else []
    levels = [order[a:b] for a, b in itertools.pairwise(cuts)]
    kind = is_text.astype(np.int64)
    upward = potentials.copy()  # what a node's subtree says about its label
    upward[levels[0]] += model.root
    message = np.zeros((n, 3))  # from a node to its parent's label
    for level in levels[:0:-1]:
        message[level] = _log_sum(model.edges[kind[level]] + upward[level][:, None, :])
        np.add.at(upward, parents[level], message[level])
    belief = upward
    for level in levels[1:]:
        without = belief[parents[level]] - message[level]
        belief[level] += _log_sum(model.edges[kind[level]].transpose(0, 2, 1) + without[:, None, :])
    belief -= belief.max(axis=1, keepdims=True)
    shares = np.exp(belief)
    return shares / shares.sum(axis=1, keepdims=True)


def _judge(pages: list[Page], model: Model) -> np.ndarray:
    """Probability of MAIN for all nodes of some pages, one page after the other."""
    parents, is_text, at, seen = [], [], [], []
    base = 0
    for page in pages:
        parents += [p + base if p >= 0 else -1 for p in page.parents]
        is_text += [t is not None for t in page.texts]
        for i in range(1, len(page.tags)):
            known = [model.features[f] for f in features(page, i) if f in model.features]
            at += [base + i] * len(known)
            seen += known
        base += len(page.tags)
    potentials = np.zeros((base, 3))
    np.add.at(potentials, np.array(at, np.int64), model.weights[np.array(seen, np.int64)])
    return marginals(np.array(parents, np.int64), np.array(is_text, bool), potentials, model)[:, MAIN]


BLOCKS = "array<struct<text:string,tag:string,main:double>>"
BLOCKS_ARROW = pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string()), ("main", pa.float64())]))


def page_blocks(pages: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns in `keep` and `blocks`: per block of text in page order its text, the tag it
    stands in and its probability of belonging to the article.

    White space inside a block is one blank. Null and empty pages have no blocks. Scripts, styles,
    comments of the markup, controls and hidden elements are no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in ta.slices(whole, "html"):
                parsed = [Page(t.as_py() or "") for t in batch.column("html")]
                main = _judge(parsed, model).tolist()
                blocks, base = [], 0
                for page in parsed:
                    blocks.append([
                        {"text": t, "tag": page.tags[page.parents[i]], "main": main[base + i]}
                        for i, t in enumerate(page.texts) if t is not None
                    ])
                    base += len(page.tags)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(blocks, BLOCKS_ARROW)], names=[*keep, "blocks"])

    kept = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{kept}blocks {BLOCKS}")


def main_text(blocks: Column, threshold: float = THRESHOLD) -> Column:
    """The article's blocks, an empty line between them; empty if there is none."""
    kept = F.filter(blocks, lambda b: b["main"] > threshold)
    return F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")


def extract(spark: SparkSession, pages: DataFrame, *keep: str) -> DataFrame:
    """The columns in `keep` with text: trains on the pages and reads them all.

    Every row is a page of its own, equal rows too. The blocks are written out, since the text is
    used several times.
    """
    model = train(pages)
    return settle(page_blocks(pages, model, *keep).withColumn("text", main_text(F.col("blocks"))).drop("blocks"), spark, "texts")
