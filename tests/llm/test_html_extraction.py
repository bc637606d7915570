from __future__ import annotations

import html
import itertools
import re
import time

import numpy as np
import pytest

from visitbook.llm import html_extraction as hx
from visitbook.llm import queries
from visitbook.llm.page_tree import Page

PAGE = "page_id bigint, url string, html string"
S = "A long enough sentence with several words, as in real articles that people read every day."


@pytest.fixture(scope="module")
def model(spark):
    return hx.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def text_of(model, source):
    page = Page(source)
    main = hx._judge([page], model)
    return [t for i, t in enumerate(page.texts) if t is not None and main[i] > hx.THRESHOLD]


def shown(source):
    return [t for t in Page(source).texts if t is not None]


def run(spark, rows, tmp_path, schema=PAGE):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages.parquet")
    df = queries.op11_html_extraction(spark, str(tmp_path))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_query_finds_every_article(spark):
    """The tables' pages say where the article is; the text between is cut out by hand."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    expected = {}
    for r in rows:
        inside = re.search("<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = [html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split() for b in re.split("</?(?:p|h1)>", inside)]
        text = "\n\n".join(" ".join(b) for b in blocks if b)
        expected[r["page_id"]] = (r["url"], text, len(text))
    found = queries.op11_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in found} == expected


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(7)
    for _ in range(20):
        n = 6
        parents = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        kind = rng.integers(0, 2, n).astype(bool)
        potentials = rng.normal(size=(n, 3))
        model = hx.Model({}, np.zeros((0, 3)), rng.normal(size=3), rng.normal(size=(2, 3, 3)))
        weight = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=n):
            score = model.root[labels[0]] + sum(potentials[i, y] for i, y in enumerate(labels))
            score += sum(model.edges[int(kind[i]), labels[parents[i]], labels[i]] for i in range(1, n))
            for i, y in enumerate(labels):
                weight[i, y] += np.exp(score)
        expected = weight / weight.sum(axis=1, keepdims=True)
        assert np.allclose(hx.marginals(parents, kind, potentials, model), expected)


def test_several_trees_at_once(model):
    pages = [Page(f"<div class='post'><p>{S}</p></div><footer>{i}</footer>") for i in range(3)]
    apart = np.concatenate([hx._judge([p], model) for p in pages])
    assert np.allclose(hx._judge(pages, model), apart)


def test_parts_of_pages_by_name(model):
    source = f"""<html><body><div class="site-header"><nav><a href=/>Home</a> <a href=/x>News</a></nav></div>
    <div id="wrapper"><div class="post-content"><h1>My title</h1><p>{S} {S}</p><p>Short one.</p>
    <ul><li>first point of mine</li><li>second point of mine</li></ul><div class="advert">Buy now! {S}</div><p>{S} End.</p></div>
    <div class="sidebar"><h3>Popular</h3><ul><li><a href=x>Other story</a></li></ul><p>{S}</p></div>
    <section id="comments"><h2>3 comments</h2><div class="comment"><p>{S} {S}</p></div></section>
    <form action=/s><p>Subscribe to our list. {S}</p><input><button>Send</button></form></div>
    <div class="cookie-banner">We use cookies. {S}</div><footer><p>{S}</p></footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert text_of(model, source) == [
        "My title", f"{S} {S}", "Short one.", "first point of mine", "second point of mine", f"{S} End."
    ]


def test_corpus_without_labelled_pages(spark):
    model = hx.train(spark.createDataFrame([(1, "u", None), (2, "u", "<p>x")], PAGE))
    assert text_of(model, f"<nav><a>x</a></nav><main><p>{S}</p></main><footer>{S}</footer>") == [S]


def test_reading_of_markup():
    assert shown("<p>one<p>two <b>bo</b>ld<br>x&amp;y &eacute;&#233;\n\t z") == ["one", "two bold x&y éé z"]
    assert shown("<title>no</title><style>p{}</style><!-- <p>no</p> --><div>a<hr>b</div>c") == ["a", "b", "c"]
    assert shown("<script>if (a<b) '</p>'</script>yes<noscript>no</noscript><textarea><p>no</textarea>") == ["yes"]
    assert shown("<a title='x>y' href=\"<p>\">li<i>n</i>k</a> <p title=it's>t</p> <p title=it's>u</p>") == ["link", "t", "u"]
    assert shown("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == list("abcdefg")
    assert shown("<div hidden>no</div><div style='display: none'>no</div><p aria-hidden=true>yes") == ["yes"]
    assert shown("<select><option>no</select><button>no</button>1 < 2 & 3 <> 4") == ["1 < 2 & 3 <> 4"]
    assert shown("") == [] and shown("  \n ") == [] and shown("plain") == ["plain"] and shown("a<") == ["a<"]


@pytest.mark.parametrize("part", ["<", "<a ", "<!--", "<div>", "<p>", "<li>", "</div>", "&", "<script>", '<a href="', "<x y='", "<!", "<b", "<p title=it's>"])
def test_faulty_pages_in_linear_time(model, part):
    started = time.perf_counter()
    text_of(model, part * 60_000)
    assert time.perf_counter() - started < 10


def test_awkward_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "just words"), (3, "u", "<nav><a href=/>x</a></nav>"),
            (4, "long", f"<article>{'<p>' + S + '</p>'}{'<p>word </p>' * 100_000}</article>")]
    found = run(spark, [(*r, "t", 1) for r in rows], tmp_path, PAGE + ", text string, blocks int")
    assert [r[0] for r in found] == [1, 2, 2, 3, 4, None]
    assert found[0] == (1, None, "", 0) and found[1] == found[2] == (2, "u", "", 0) and found[3][2:] == ("", 0)
    assert found[4][2].count("\n\n") == 100_000 and found[4][3] == len(found[4][2])


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
