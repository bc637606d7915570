"""URL filtering by host rules and by pattern rules that are indexed by a rare literal token.

A pattern rule is found through the one of its literal tokens that is rarest among the table's
own URLs. A URL's tokens fetch the rules to try, and only those run their expression.

Pattern rules: `||` begins at a label of the host, `^` is a character that ends a token (or the
end), `*` is any text, `@@` in front makes an exception. All else is literal, in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Host rules of the contract: verdict, host, path.
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# Pattern rules for what the host rules leave open.
PATTERN_RULES = (
    "||casino-win.^*", "||casino^", "/casino/", "-casino-", "||free-bets.", "||bets^", "/betting/", "||poker^",
    "||adult-x.", "||adult^", "/adult/*/watch", "||xxx^", "||cheap-pills.", "/pills/", "||pharmacy^", "||viagra^",
    "||spam-farm.", "||spam^", "/link-farm/", "||ads-track.", "||ads^", "||adserver^", "/banner/ads/", "||track^",
    "||doubleclick.net^", "/popunder^", "/affiliate/click^", "^phishing^", "-malware-", "||warez^", "/torrent/",
    "^crack^keygen^", "||url-shortener^", "/login.php^*redirect", "sessionid=*^password=", "*.exe^",
    "@@||casino-museum.", "@@/ads/standards^", "@@||track^/field/", "@@/spam/filtering^",
)

SEPARATOR = r"([^a-z0-9_.%-]|$)"
HOST_LABEL = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?"
TOKEN = re.compile("[a-z0-9]+")


def expression(rule: str) -> str:
    """The rule as a regular expression over the lower-cased URL."""
    body = rule.removeprefix("@@")
    start = HOST_LABEL if body.startswith("||") else ""
    marks = {"*": ".*", "^": SEPARATOR}
    return start + "".join(marks.get(c) or re.escape(c) for c in body.removeprefix("||"))


def literal_tokens(rule: str) -> set[str]:
    """Tokens that every matching URL holds whole: those the rule bounds on both sides."""
    body = rule.removeprefix("@@")
    anchored, body = body.startswith("||"), body.removeprefix("||")
    found = set()
    for m in TOKEN.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else anchored
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.add(m.group())
    return found


@dataclass(frozen=True)
class RuleIndex:
    """Pattern rules by token; rules without a whole token are tried on every URL."""

    by_token: dict[str, list[tuple[bool, str]]]
    always: list[tuple[bool, str]]

    @classmethod
    def of(cls, rules: Sequence[str], counts: dict[str, int]) -> RuleIndex:
        """`counts`: in how many URLs each token occurs."""
        by_token: dict[str, list[tuple[bool, str]]] = {}
        always = []
        for rule in rules:
            entry = (rule.startswith("@@"), expression(rule))
            tokens = literal_tokens(rule)
            if tokens:
                by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                always.append(entry)
        return cls(by_token, always)


class Matcher:
    """Runs the expressions of the rules that a URL's tokens fetch."""

    def __init__(self, index: RuleIndex):
        self.by_token = {t: [(x, re.compile(p)) for x, p in r] for t, r in index.by_token.items()}
        self.always = [(x, re.compile(p)) for x, p in index.always]

    def verdict(self, url: str) -> str:
        """block if a rule fits and no exception does, else allow."""
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), url)
        blocked = False
        fetched = [r for t in set(TOKEN.findall(low)) & self.by_token.keys() for r in self.by_token[t]]
        for exception, pattern in [*fetched, *self.always]:
            if (exception or not blocked) and pattern.search(low):
                if exception:
                    return "allow"
                blocked = True
        return "block" if blocked else "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def host_rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> tuple[str, str] | None:
    """Name and verdict of the longest rule that fits the host, or a domain above it, and the path."""
    fits = [
        (rule_host + rule_path, verdict)
        for verdict, rule_host, rule_path in rules
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path)
    ]
    return max(fits, key=lambda r: (len(r[0]), r[0]), default=None)


def token_counts(urls: DataFrame, column: str, rules: Sequence[str]) -> dict[str, int]:
    """In how many URLs of the whole table each literal token of the rules occurs.

    What reaches the driver has at most one row per token of the rules.
    """
    wanted = sorted({t for r in rules for t in literal_tokens(r)})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9]+)"), F.lit(1)))
    # Only the rules' own tokens leave the array, so what is shuffled is small.
    hits = urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(
    pages: DataFrame, column: str = "url", host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    pattern_rules: Sequence[str] = PATTERN_RULES,
) -> DataFrame:
    """The rows of `pages` with host, path, rule and verdict.

    The longest host rule that fits decides (ties: the later by name) and is named in `rule`;
    else `rule` is null and the pattern rules decide. A null URL, or one without `://`, has an
    empty host and path; the pattern rules see it as it is (null: empty). Columns named like a
    result are replaced; equal rows are judged one by one. The rules travel with the task:
    their number is the caller's, not the table's.
    """
    index = RuleIndex.of(pattern_rules, token_counts(pages, column, pattern_rules))
    results = ["host", "path", "rule", "verdict"]
    kept = pages.drop(*[c for c in results if c != column])
    blank = kept.withColumns({c: F.lit(None).cast("string") for c in results if c != column})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(index)
        rules = tuple(host_rules)
        for batch in batches:
            rows = []
            for url in batch.column(column).to_pylist():
                host, path = split_url(url)
                rule, verdict = host_rule(host, path, rules) or (None, None)
                rows.append((host, path, rule, verdict or matcher.verdict(url or "")))
            new = dict(zip(results, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in results}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[c], pa.string()) if c in new and c != column else batch.column(c) for c in batch.schema.names],
                names=batch.schema.names,
            )

    return blank.mapInArrow(run, blank.schema)


def sql_verdict(url: Column | str) -> str:
    """The pattern rules' verdict as SQL over a column that holds a lower-cased URL."""
    tests = {
        kind: [f"regexp_matches({url}, '{expression(r)}')" for r in PATTERN_RULES if r.startswith("@@") == kind]
        for kind in (False, True)
    }
    block, except_ = (" OR ".join(tests[k]) for k in (False, True))
    return f"CASE WHEN ({block}) AND NOT ({except_}) THEN 'block' ELSE 'allow' END"
