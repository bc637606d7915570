"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from visitbook.llm import jaccard_join as jj
from visitbook.llm import license_scan as lic
from visitbook.llm import url_filter as url

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


DECONTAMINATION = f"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all({lowered("text")}, '{WORDS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n,
    array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all({lowered("text")}, '{WORDS}') AS w FROM documents),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM doc_words, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, p.n, item FROM places AS p JOIN windows AS v ON p.n = v.n AND p.gram = v.gram),
hit_words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

URL_FILTER = f"""
WITH split AS (
  SELECT page_id, url, contains(coalesce(url, ''), '://') AS whole,
    substr(url, strpos(url, '://') + 3) AS rest FROM pages),
parts AS (
  SELECT page_id, CASE WHEN whole THEN {lowered("regexp_extract(rest, '^[^/?#]*')")} ELSE '' END AS host,
    CASE WHEN whole THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    {lowered("url")} AS low FROM split),
rules AS (SELECT * FROM (VALUES {values(url.HOST_RULES)}) AS r(kind, rule_host, rule_path)),
fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(kind, length(rule_host || rule_path)) AS kind
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(kind, {url.sql_verdict("low")}) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

LICENSE_SCAN = f"""
WITH notices AS (
  SELECT *, string_split(notice, ' ') AS tw, len(string_split(notice, ' ')) - {lic.K - 1} AS runs
  FROM (VALUES {values((i, a, t, i < len(lic.PHRASES)) for i, (a, t) in enumerate([*lic.PHRASES, *lic.TEMPLATES]))})
    AS v(template, label, notice, is_phrase)),
positions AS (
  SELECT template, label, is_phrase, runs, t_at, array_to_string(tw[t_at + 1 : t_at + {lic.K}], ' ') AS gram
  FROM notices, unnest(range(0, runs)) AS t(t_at)),
doc_words AS (
  SELECT doc_id, regexp_extract_all({lowered("text")}, '{WORDS}') AS w FROM documents),
grams AS (
  SELECT doc_id, place, array_to_string(w[place + 1 : place + {lic.K}], ' ') AS gram
  FROM doc_words, unnest(range(0, len(w) - {lic.K - 1})) AS t(place)),
diagonals AS (
  SELECT doc_id, template, label, is_phrase, runs, place - t_at AS diagonal, count(*) AS hits,
    min(place) AS first_place, max(place) + {lic.K} AS last_place
  FROM grams JOIN positions USING (gram) GROUP BY ALL),
jumps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {lic.DRIFT} THEN 0 ELSE 1 END AS jump
  FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
marked AS (
  SELECT *, sum(jump) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS merged,
    is_phrase AND hits = runs AS whole FROM jumps),
grouped AS (
  SELECT doc_id, label, sum(hits) / runs AS ratio, max(last_place) - min(first_place) AS span,
    runs + {lic.K - 1} AS words, count(*) FILTER (whole) AS n_base,
    min(diagonal) FILTER (whole) AS first_word, max(diagonal) FILTER (whole) AS last_word
  FROM marked GROUP BY doc_id, template, label, runs, merged),
judged AS (
  SELECT *, CASE WHEN span <= {lic.STRETCH} * words * greatest(1.0, ratio) THEN least(1.0, ratio)
    ELSE least(1.0, ratio, {lic.COVERAGE / 2}) END AS share FROM grouped),
per_doc AS (
  SELECT doc_id, sum(n_base) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0 OR share >= {lic.COVERAGE}) AS labels,
    max(CASE WHEN n_base > 0 THEN 1.0 ELSE share END) AS score
  FROM judged GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM doc_words LEFT JOIN per_doc USING (doc_id)
"""

# All pairs that share a shingle, and what their links connect.
JACCARD_JOIN = f"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all({lowered("text")}, '{WORDS}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least({jj.SHINGLE}, len(w)) - 1], ' ') AS shingle
  FROM doc_words, unnest(range(1, len(w) - least({jj.SHINGLE}, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles AS a JOIN shingles AS b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes AS p ON x = p.doc_id JOIN sizes AS q ON y = q.doc_id
  WHERE c >= {jj.SIMILARITY} * (p.n + q.n - c) - 1e-6),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, y FROM reach JOIN links ON other = x),
classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
counts AS (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM classes LEFT JOIN counts USING (doc_id)
"""

def counted(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(counted, ["doc_id", "source", "lang", "n_chars", text])) + ")"


# CRC-32 by its table of bytes.
CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) AS bytes(b))"""


def crc32(text: str) -> str:
    """Of a text of ASCII characters; `t` is the column of CRC_TABLE."""
    return f"""xor(list_reduce([4294967295] || [CAST(ord(d) AS BIGINT) FOR d IN string_split({text}, '')],
      lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295)"""


# Every level of every tree as a list.
MERKLE_MANIFEST = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered,
    {crc32("CAST(doc_id AS VARCHAR)")} AS crc
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
trees AS (
  SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, [sha256(array_to_string(nodes[i + 1 : i + 16], '')) FOR i IN range(0, len(nodes), 16)]
  FROM trees WHERE len(nodes) > 1),
subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM trees WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, [sha256(array_to_string(nodes[i + 1 : i + 16], '')) FOR i IN range(0, len(nodes), 16)]
  FROM tops WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1),
below AS (
  SELECT p.source, p.place, 0 AS part, level, nodes, p.place // CAST(16 ** level AS BIGINT) AS spot
  FROM placed AS p JOIN trees AS t ON p.source IS NOT DISTINCT FROM t.source WHERE len(nodes) > 1),
above AS (SELECT source, level, nodes, place // CAST(16 ** level AS BIGINT) AS spot FROM subroots, tops WHERE len(nodes) > 1),
steps AS (
  SELECT * FROM below
  UNION ALL SELECT p.source, p.place, 1, level, nodes, spot FROM placed AS p JOIN above AS a ON p.source IS NOT DISTINCT FROM a.source),
paths AS (
  SELECT source, place, list({{'b': array_to_string(nodes[spot - spot % 16 + 1 : spot], ''),
    'a': array_to_string(nodes[spot + 2 : spot - spot % 16 + 16], ''), 'h': ''}} ORDER BY part, level) AS path
  FROM steps GROUP BY source, place),
proofs AS (
  SELECT doc_id, leaf, subroot, root, coalesce(path, []) AS path,
    CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS start
  FROM placed AS p JOIN subroots AS s ON p.source IS NOT DISTINCT FROM s.source CROSS JOIN root
  LEFT JOIN paths AS q ON p.source IS NOT DISTINCT FROM q.source AND p.place = q.place)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.b || s.a FOR s IN path], '')) AS proof_sha256,
  list_reduce([{{'b': '', 'a': '', 'h': start}}] || path, lambda x, y: {{'b': '', 'a': '', 'h': sha256(y.b || x.h || y.a)}}).h AS folded_root,
  folded_root = root AS verified
FROM proofs
"""



def edited(way: str, letter: str, cost: str = "0", allowed: str = "true") -> str:
    """A way to a state of the roles' automaton with one more edit; dear if it is not allowed."""
    return f"{{'c': CASE WHEN {allowed} THEN {way}.c + {cost} ELSE 1000000000 END, 'a': {way}.a || '{letter}'}}"


def inserted(ways: str) -> str:
    """The ways z (start), s, u, a of a struct, and what insertions reach from them."""
    u = f"least({ways}.u, {edited(ways + '.z', 'I', '5')}, {edited(ways + '.s', 'I', '5')}, {edited(ways + '.a', 'I', '5')})"
    return f"{{'z': {ways}.z, 's': {ways}.s, 'u': {u}, 'a': least({ways}.a, {edited('(' + u + ')', 'I', '5')})}}"


def after_row(ways: str) -> str:
    """The ways after one more row, of initial r and fault f."""
    stays, cut = "f NOT IN ('blank', 'duplicate')", "CASE f WHEN 'truncated' THEN 5 ELSE 0 END"
    reach = {"z": "", "s": "z", "u": "zsa", "a": "u"}  # from which state a role leads to each
    new = {}
    for state, sources in reach.items():
        offers = [edited(f"{ways}.{state}", "D", "2")]
        for source in sources:
            offers.append(edited(f"{ways}.{source}", "K", cut, f"{stays} AND r = '{state}'"))
            if state in "ua":
                offers.append(edited(f"{ways}.{source}", "R", f"{cut} + 1", stays))
        new[state] = f"least({', '.join(offers)})" if len(offers) > 1 else offers[0]
    return "{" + ", ".join(f"'{s}': {w}" for s, w in new.items()) + "}"


# The cheapest way to each state, row by row, and then the edits played back.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(i)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS solid
  FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS r, CASE WHEN solid = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f FROM placed),
paired AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM marked),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
    count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM paired GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0 AS i, n, {{'z': {{'c': 0, 'a': ''}}, 's': {{'c': 1000000000, 'a': ''}}, 'u': {{'c': 1000000000, 'a': ''}},
    'a': {{'c': 1000000000, 'a': ''}}}} AS w FROM counts
  UNION ALL
  SELECT conv_id, i, n, {after_row("w")} FROM (
    SELECT e.conv_id, m.i, e.n, m.r, m.f, {inserted("e.w")} AS w
    FROM ways AS e JOIN marked AS m ON e.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = e.i + 1)),
best AS (SELECT conv_id, least(w.z, w.a) AS b FROM (SELECT conv_id, {inserted("w")} AS w FROM ways WHERE i = n)),
played AS (
  SELECT conv_id, b.a AS audit, 0 AS at_edit, 0 AS at_row, '' AS last, CAST([] AS VARCHAR[]) AS said FROM best
  UNION ALL
  SELECT conv_id, audit, at_edit, at_row, CASE edit WHEN 'D' THEN last ELSE left(given, 1) END,
    CASE edit WHEN 'D' THEN said ELSE list_append(said, given || ':' || text) END
  FROM (
    SELECT p.conv_id, audit, at_edit + 1 AS at_edit, at_row + CAST(edit <> 'I' AS INTEGER) AS at_row, last, said, edit,
      CASE WHEN edit IN ('K', 'D') THEN m.role WHEN last = 'u' THEN 'assistant' ELSE 'user' END AS given,
      CASE edit WHEN 'I' THEN '' ELSE m.text END AS text
    FROM (SELECT *, audit[at_edit + 1] AS edit FROM played WHERE at_edit < length(audit)) AS p
    LEFT JOIN marked AS m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = p.at_row + 1)),
repaired AS (SELECT conv_id, sha256(array_to_string(said, chr(10))) AS digest FROM played WHERE at_edit = length(audit))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.b.c, 0) AS BIGINT) AS cost,
  coalesce(b.b.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN counts AS c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best AS b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired AS r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""

ORACLE: dict[str, str] = {
    "op4_url_filter": URL_FILTER,
    "op5_decontamination": DECONTAMINATION,
    "op7_license_scan": LICENSE_SCAN,
    "op9_jaccard_join": JACCARD_JOIN,
    "op12_merkle_manifest": MERKLE_MANIFEST,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
