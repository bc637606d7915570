from __future__ import annotations

import re

import pytest
from cases import SF

from visitbook.llm import url_filter as uf
from visitbook.llm.queries import QUERIES

PAGES = "page_id bigint, url string, html string"


def brute_force(url):
    """All rules on the URL, without an index."""
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in uf.HOST_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    fits = {r.startswith("@@") for r in uf.PATTERN_RULES if re.search(uf.expression(r), low)}
    return host, path, None, "block" if fits == {False} else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "http://a.net/x", "http://example.net/en/1",
    "https://Example.COM/de/9?x#y", "https://sub.example.com/de", "http://x.org/fr/", "http://x.org/FR/", "http://notnet/",
    "http://casino-win.example.com/en/1", "http://www.casino-win.example.com?q", "http://x.example.com/casino/now",
    "http://x.example.com/casinos/", "http://x.example.com/adult/a/b/watch", "HTTP://ADS.example.com/", "http://h.com/a.exe",
    "http://h.com/a.exe?x", "http://h.com/login.php?x=redirect", "http://track.h.com/field/1", "http://track.h.com/other",
    "http://casino-museum.example.com/casino/", "http://h.com/x?sessionid=1&password=2", "http://h.com/ÄCRACK/keygen",
    "http://h.com/crack/keygen/", "http://a://b/c?d", "http://user@host:80/en/", "http://h.com#/casino/",
]


@pytest.mark.parametrize("url", URLS)
def test_index_changes_no_verdict(url):
    host, path = uf.split_url(url)
    rule, verdict = uf.host_rule(host, path, uf.HOST_RULES) or (None, None)
    matcher = uf.Matcher(uf.RuleIndex.of(uf.PATTERN_RULES, {}))
    assert (host, path, rule, verdict or matcher.verdict(url or "")) == brute_force(url)


def test_rules_are_indexed_by_their_rarest_token():
    counts = {"casino": 9, "win": 2, "crack": 5, "keygen": 1}
    index = uf.RuleIndex.of(["||casino-win.", "^crack^keygen^", "*.exe^", "@@/casino/"], counts)
    assert {t: len(r) for t, r in index.by_token.items()} == {"win": 1, "keygen": 1, "exe": 1, "casino": 1}
    assert uf.literal_tokens("||ads*track^") == {"track"} - {"track"}
    assert uf.RuleIndex.of(["abc"], {}).always == [(False, "abc")]


def test_query_equals_brute_force(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op4_url_filter"](spark, SF).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {k: brute_force(u) for k, u in urls.items()}


def test_awkward_rows(spark):
    rows = [(None, u, None) for u in URLS] + [(1, "http://h.com/" + "a/" * 40_000 + "casino/", "x")] * 2
    frame = spark.createDataFrame(rows, PAGES).withColumnRenamed("html", "verdict")
    got = uf.judge_urls(frame).collect()
    assert sorted(str((r.host, r.path, r.rule, r.verdict)) for r in got) == sorted(str(brute_force(r[1])) for r in rows)
    assert uf.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
    assert uf.judge_urls(frame, pattern_rules=[], host_rules=[]).where("verdict = 'block'").count() == 0
