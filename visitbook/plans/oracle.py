"""The registered queries as SQL for an independent engine."""

from __future__ import annotations

# --- shared fragments -------------------------------------------------------------

VISITS = """
visits AS (
  SELECT o_orderkey AS id, c_name AS name, c_mktsegment AS adresse, o_orderdate AS created_at,
         o_orderpriority AS signature, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

LOG = """
log AS (
  SELECT event_id AS id, ts AS "timestamp",
         CASE WHEN event_type = 'view' THEN '' WHEN event_type <> 'error' THEN 'user_' || user_id END AS user_type,
         event_type AS action,
         CASE WHEN event_type <> 'signup' THEN props END AS details
  FROM events
)"""

LOG_LINE = """
'UserType: ' || coalesce(nullif(user_type, ''), 'unknown') || ' | Action: ' || action
|| ' | Details: ' || coalesce(details, '')"""

# Submitted fields as columns: a has_ flag where a field may be absent.
REQUESTS = """
req AS (
  SELECT event_id AS seq, user_id AS id, event_type AS kind, ts AS received_at,
    CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op,
    CASE WHEN value < 5 THEN 'medecins' WHEN value < 15 THEN 'infirmiers' ELSE 'receptionistes' END AS role,
    'Dr User ' || user_id AS shown_user,
    CASE WHEN value >= 1 AND value < 2 THEN '' ELSE 'Name ' || user_id END AS name,
    event_type <> 'purchase' AS has_adresse,
    CASE WHEN event_type = 'view' THEN '' ELSE props END AS adresse,
    event_type = 'signup' AS has_birth,
    CASE WHEN value < 8 THEN '' WHEN value < 9 THEN '31/12/1990' ELSE strftime(ts, '%Y-%m-%d') END AS birth,
    CASE WHEN event_type = 'click' AND value < 3 THEN '' ELSE user_id::VARCHAR END AS age_years,
    CASE WHEN value < 1 THEN '' WHEN value >= 4 AND value < 5 THEN '12.5' ELSE '6' END AS age_months,
    value <= 150 AS has_days,
    event_type <> 'error' AS has_poids,
    CASE WHEN value >= 5 AND value < 6 THEN 'abc' WHEN value >= 6 AND value < 7 THEN '' ELSE value::VARCHAR END AS poids,
    event_type <> 'purchase' AS has_temperature,
    CASE WHEN value < 3 THEN '' WHEN value < 4 THEN 'hot' ELSE '38.5' END AS temperature,
    event_type = 'click' AS has_phone,
    value > 200 AS has_unknown
  FROM events
)"""

INSERT_ERRORS = """
concat_ws('; ',
  CASE WHEN name = '' THEN 'name is required' END,
  CASE WHEN has_unknown THEN 'unknown column' END,
  CASE WHEN age_months = '12.5' THEN 'age_months must be an integer' END,
  CASE WHEN NOT has_days THEN 'age_days must be an integer' END,
  CASE WHEN has_birth AND birth = '31/12/1990' THEN 'date_of_birth must be a date' END,
  CASE WHEN has_poids AND poids = 'abc' THEN 'poids must be a number' END,
  CASE WHEN has_temperature AND temperature = 'hot' THEN 'temperature must be a number' END)"""

UPDATE_ERRORS = """
concat_ws('; ',
  CASE WHEN name = '' THEN 'name is required' END,
  CASE WHEN has_unknown THEN 'unknown column' END,
  CASE WHEN has_birth AND birth = '31/12/1990' THEN 'date_of_birth must be a date' END,
  CASE WHEN has_poids AND poids = 'abc' THEN 'poids must be a number' END,
  CASE WHEN has_temperature AND temperature = 'hot' THEN 'temperature must be a number' END,
  CASE WHEN age_months = '12.5' THEN 'age_months must be an integer' END)"""

# A new visit as stored columns.
BORN = """
  name,
  CASE WHEN has_adresse THEN nullif(adresse, '') END AS adresse,
  round_even(coalesce(try_cast(nullif(age_years, '') AS INTEGER), 0)
    + coalesce(try_cast(nullif(age_months, '') AS INTEGER), 0) / 12.0::DOUBLE + 10 / 365.0::DOUBLE, 10) AS age,
  CASE WHEN has_birth THEN try_cast(nullif(birth, '') AS DATE) END AS date_of_birth,
  CASE WHEN has_poids THEN try_cast(poids AS DOUBLE) END AS poids,
  CASE WHEN has_temperature THEN try_cast(temperature AS DOUBLE) END AS temperature,
  CASE WHEN role = 'medecins' THEN shown_user END AS signature,
  CAST(received_at + INTERVAL 1 HOUR AS DATE) AS created_at,
  coalesce(try_cast(nullif(age_years, '') AS INTEGER), 0) AS age_years,
  coalesce(try_cast(nullif(age_months, '') AS INTEGER), 0) AS age_months,
  10 AS age_days,
  CASE WHEN has_phone THEN '' END AS phone_number"""


def _updated(column: str, expression: str, condition: str = "true") -> str:
    """Latest update of one column within a life; a null struct if there is none."""
    return (
        f"arg_max({{'v': {expression}}}, seq) FILTER (WHERE op = 'update' AND effective AND ({condition})) AS u_{column}"
    )


UPDATES = ",\n    ".join(
    [
        _updated("name", "name"),
        _updated("adresse", "nullif(adresse, '')", "has_adresse"),
        _updated("date_of_birth", "try_cast(nullif(birth, '') AS DATE)", "has_birth"),
        _updated("poids", "try_cast(poids AS DOUBLE)", "has_poids"),
        _updated("temperature", "try_cast(temperature AS DOUBLE)", "has_temperature"),
        _updated("signature", "shown_user", "role = 'medecins'"),
        _updated("age_years", "try_cast(age_years AS INTEGER)"),
        _updated("age_months", "try_cast(age_months AS INTEGER)"),
        _updated("age_days", "10", "has_days"),
        _updated("phone_number", "''", "has_phone"),
    ]
)

UPDATABLE = [
    "name", "adresse", "date_of_birth", "poids", "temperature", "signature",
    "age_years", "age_months", "age_days", "phone_number",
]

# Every life of every id, run through in order: the stored row lives first, each
# deletion ends a life, the first insert after it begins the next one.
LIVES = f"""
WITH {VISITS}, {REQUESTS},
stored AS (
  SELECT id, name, adresse, CAST(NULL AS DOUBLE) AS age, CAST(NULL AS DATE) AS date_of_birth,
    CAST(NULL AS DOUBLE) AS poids, CAST(NULL AS DOUBLE) AS temperature, signature,
    CAST(created_at AS DATE) AS created_at, CAST(NULL AS INTEGER) AS age_years,
    CAST(NULL AS INTEGER) AS age_months, CAST(NULL AS INTEGER) AS age_days, CAST(NULL AS VARCHAR) AS phone_number
  FROM visits
),
checked AS (
  SELECT *, CASE op WHEN 'insert' THEN {INSERT_ERRORS} WHEN 'update' THEN {UPDATE_ERRORS} ELSE '' END AS errors
  FROM req
),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END)
              OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life
  FROM checked WHERE errors = ''
),
placed AS (
  SELECT n.*, n.life = 0 AND s.id IS NOT NULL AS from_stored,
         min(CASE WHEN op = 'insert' THEN seq END) OVER (PARTITION BY n.id, life) AS start
  FROM numbered n LEFT JOIN (SELECT id FROM stored) s ON n.id = s.id
),
marked AS (SELECT *, from_stored OR seq > start AS effective FROM placed),
folded AS (
  SELECT id, life, bool_or(from_stored) AS from_stored, min(start) AS start,
    max(CASE WHEN op = 'delete' THEN seq END) AS ended,
    {UPDATES}
  FROM marked GROUP BY id, life
),
origin AS (
  SELECT id, CAST(0 AS HUGEINT) AS life, true AS from_stored, * EXCLUDE (id) FROM stored
  UNION ALL
  SELECT id, life, false, {BORN} FROM marked WHERE op = 'insert' AND NOT from_stored AND seq = start
),
lives AS (
  SELECT o.id, f.ended, o.age, o.created_at,
    {", ".join(f"CASE WHEN f.u_{c} IS NULL THEN o.{c} ELSE f.u_{c}.v END AS {c}" for c in UPDATABLE)}
  FROM origin o LEFT JOIN folded f ON o.id = f.id AND o.life = f.life
)"""

LIFE_COLUMNS = (
    "name, adresse, age, date_of_birth, poids, temperature, signature, created_at, "
    "age_years, age_months, age_days, phone_number"
)

INVOICES = """
docs AS (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN 100.0::DOUBLE - floor(l_discount * 100) ELSE 100.0::DOUBLE END AS pct,
    l_returnflag = 'N' AND l_linestatus = 'F' AND l_partkey % 89 <> 0 AS blank_percent, l_linenumber >= 7 AS no_sections,
    l_partkey % 89 = 0 AND l_linenumber % 3 < 2 AS endless_percent, l_partkey % 89 = 0 AND l_linenumber % 3 = 2 AS huge_percent,
    l_partkey % 97 = 0 OR l_partkey % 101 = 0 AS odd_goods, l_linenumber % 3 = 0 AS odd_is_nan
  FROM lineitem
),
-- A form drops articles that are no numbers; other odd numbers refuse the document.
priced AS (
  SELECT *, CASE WHEN odd_goods THEN 0 ELSE round_even(l_extendedprice * l_quantity * pct / 100, 0)::BIGINT END AS goods,
    round_even(l_tax * 1000 * 1.0::DOUBLE * pct / 100, 0)::BIGINT AS tax,
    round_even(10.5::DOUBLE * (l_discount * 100) * pct / 100, 0)::BIGINT AS rebate,
    NOT odd_goods OR l_tax > 0 AS has_first
  FROM docs WHERE NOT blank_percent AND NOT no_sections AND NOT endless_percent AND NOT huge_percent
    AND (NOT odd_goods OR odd_is_nan)
),
formed AS (SELECT * FROM priced WHERE has_first OR l_discount > 0)"""

ITEMS = """
items AS (
  SELECT l_orderkey,
    CASE WHEN l_partkey % 97 = 0 THEN 'abc' WHEN l_partkey % 103 = 0 THEN '4 000 000 000'
      WHEN l_partkey % 107 <> 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS quantity,
    CASE WHEN l_partkey % 101 = 0 THEN '' WHEN l_partkey % 103 = 0 THEN '4000000000'
      WHEN l_partkey % 109 <> 0 THEN (floor(l_extendedprice)::BIGINT // 1000) || ' '
        || lpad((floor(l_extendedprice)::BIGINT % 1000)::VARCHAR, 3, '0') END AS price
  FROM lineitem),
read_items AS (
  SELECT *, quantity IS NULL OR price IS NULL AS missing,
    try_cast(replace(quantity, ' ', '') AS BIGINT) AS q, try_cast(replace(price, ' ', '') AS BIGINT) AS p FROM items),
sums AS (
  SELECT l_orderkey, bool_or(missing) AS missing, bool_or(NOT missing AND (q IS NULL OR p IS NULL)) AS unread,
    sum(CAST(q AS DECIMAL(19, 0)) * CAST(p AS DECIMAL(19, 0))) AS amount FROM read_items GROUP BY 1),
bills AS (
  SELECT l_orderkey, CASE WHEN NOT missing AND NOT unread THEN try_cast(amount AS BIGINT) END AS total,
    concat_ws('; ', CASE WHEN missing THEN 'quantity and price are required' END,
      CASE WHEN unread THEN 'quantity and price must be whole numbers' END,
      CASE WHEN NOT missing AND NOT unread AND try_cast(amount AS BIGINT) IS NULL THEN 'total is too large' END) AS errors
  FROM sums)"""

MONTHS = (
    "['Janvier', 'Février', 'Mars', 'Avril', 'Mai', 'Juin', "
    "'Juillet', 'Août', 'Septembre', 'Octobre', 'Novembre', 'Décembre']"
)


def _title(c: str) -> str:
    """Title case for words separated by single blanks."""
    return f"array_to_string([upper(left(w, 1)) || lower(substring(w, 2)) FOR w IN string_split({c}, ' ')], ' ')"


def _series(step: str) -> str:
    return f"""
WITH counts AS (
  SELECT CAST(date_trunc('{step}', o_orderdate) AS DATE) AS {step}, count(*) AS n FROM orders
  WHERE o_orderdate IS NOT NULL GROUP BY 1
), spine AS (
  SELECT CAST(unnest(generate_series(min({step}), max({step}), INTERVAL 1 {step})) AS DATE) AS {step} FROM counts
)
SELECT spine.{step}, coalesce(n, 0) AS n, coalesce(n, 0) * 10000 AS revenue
FROM spine LEFT JOIN counts USING ({step})"""


def _ellipsis(c: str) -> str:
    return f"CASE WHEN length({c}) > 30 THEN left({c}, 30) || '...' ELSE coalesce({c}, '') END"


ORACLE: dict[str, str] = {
    "daily_revenue": _series("day"),
    "monthly_revenue": _series("month"),
    "date_bounds": """
SELECT CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders""",
    "top_names": f"""
SELECT {_title("name")} AS name, n FROM (
  SELECT lower(strip_accents(trim(p_name))) AS name, count(*) AS n FROM part
  WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 8)""",
    "top_addresses": f"""
WITH {VISITS} SELECT adresse, count(*) AS n FROM visits WHERE adresse IS NOT NULL
GROUP BY 1 ORDER BY n DESC, adresse LIMIT 10""",
    "value_distribution": f"""
WITH {VISITS}, tall AS (
  SELECT 'adresse' AS "column", adresse AS "value" FROM visits
  UNION ALL SELECT 'sexe', CASE WHEN status <> 'P' THEN status END FROM visits
  UNION ALL SELECT 'groupe_sanguin', CASE WHEN signature = '5-LOW' THEN '' ELSE signature END FROM visits)
SELECT "column", "value", count(*) AS n FROM tall WHERE "value" IS NOT NULL AND "value" <> '' GROUP BY 1, 2""",
    "histogram_value": """
WITH ends AS (SELECT min(value) AS low, (max(value) - min(value)) / 10 AS width FROM events),
binned AS (
  SELECT least(CAST(floor((value - low) / width) AS BIGINT), 9) AS bin, count(*) AS n FROM events, ends GROUP BY 1)
SELECT b AS bin, printf('%.1f - %.1f', low + b * width, low + b * width + width) AS label, coalesce(n, 0) AS n
FROM range(10) AS bins(b) CROSS JOIN ends LEFT JOIN binned ON b = bin""",
    "search_parts": """
SELECT p_partkey AS id, p_name AS name, p_type AS adresse, p_brand FROM part
WHERE p_name ILIKE '%AN%' OR p_type ILIKE '%AN%'""",
    "search_wildcard": """
SELECT p_partkey AS id, p_name AS name, p_type AS adresse, p_brand FROM part
WHERE p_name ILIKE '%r_d%g%' OR p_type ILIKE '%r_d%g%'""",
    "search_many": """
SELECT p_partkey AS id, p_name AS name, p_type AS adresse, p_brand, q
FROM part JOIN (VALUES ('ring'), ('ECO'), ('b%t'), ('zzz'), ('')) AS queries(q)
  ON p_name ILIKE '%' || q || '%' OR p_type ILIKE '%' || q || '%'""",
    "indexed_search": """
SELECT p_partkey AS id, p_name AS name, p_type AS adresse, p_brand FROM part
WHERE p_name ILIKE '%L_wid%ET%' OR p_type ILIKE '%L_wid%ET%'""",
    "search_table": """
WITH pieces AS (
  SELECT p_partkey % 4 AS kind, p_type, substr(p_name, p_partkey % 5 + 1, p_partkey % 9 + 1) AS piece FROM part),
queries AS (
  SELECT DISTINCT CASE kind WHEN 1 THEN upper(piece) WHEN 2 THEN replace(piece, 'e', '_')
    WHEN 3 THEN piece || '%' || right(p_type, 2) ELSE piece END AS q FROM pieces),
texts AS (SELECT DISTINCT p_name, p_type FROM part),
met AS (
  SELECT p_name, p_type, q FROM texts, queries
  WHERE p_name ILIKE '%' || q || '%' OR p_type ILIKE '%' || q || '%')
SELECT p_partkey AS id, q FROM part JOIN met USING (p_name, p_type)""",
    "visits_by_id": f"""
WITH {VISITS} SELECT id, name, created_at FROM visits WHERE id IN (SELECT user_id FROM events)""",
    "visit_by_id": f"WITH {VISITS} SELECT id, name, created_at FROM visits WHERE id = 7",
    "latest_visits": f"""
WITH {VISITS} SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Date de création", {_ellipsis("name")} AS "Nom",
  {_ellipsis("adresse")} AS "Adresse", '' AS "Numero de telephone", '' AS "Rendez-vous", '' AS "Nouveaux cas", '' AS "Age"
FROM visits ORDER BY created_at DESC, id LIMIT 20""",
    "search_listing": f"""
WITH {VISITS} SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Date de création", {_ellipsis("name")} AS "Nom",
  {_ellipsis("adresse")} AS "Adresse", '' AS "Numero de telephone", '' AS "Rendez-vous", '' AS "Nouveaux cas",
  '' AS "Age", '' AS "Poids", '' AS "Taille", '' AS "Tension", '' AS "Température",
  '' AS "Hypothèse de diagnostique", '' AS "Renseignement clinique", '' AS "Bilan", '' AS "Conclusion du bilan",
  '' AS "Ordonnance", {_ellipsis("signature")} AS "Signature"
FROM visits WHERE name ILIKE '%auto%' OR adresse ILIKE '%auto%' ORDER BY created_at DESC, id LIMIT 50""",
    "nurse_columns": f"""
WITH {VISITS} SELECT created_at AS "Date de création", name AS "Nom", CAST(NULL AS DOUBLE) AS "Poids",
  CAST(NULL AS DOUBLE) AS "Taille", CAST(NULL AS DOUBLE) AS "Tension", CAST(NULL AS DOUBLE) AS "Température"
FROM visits""",
    "visit_history": (HISTORY := f"""
WITH {VISITS}, persons AS (SELECT DISTINCT name FROM visits WHERE id IN (SELECT user_id FROM events))
SELECT name, id, created_at, count(*) OVER (PARTITION BY name) AS n_visits
FROM visits WHERE name IN (SELECT name FROM persons)"""),
    "laid_out_history": HISTORY,
    "laid_out_revenue": f"""
SELECT * FROM ({_series("day").replace("IS NOT NULL", "BETWEEN TIMESTAMP '1995-03-20' AND TIMESTAMP '1995-05-10 23:59:59.999999'")})""",
    "history_of_one": f"""
WITH {VISITS} SELECT id, name, created_at FROM visits WHERE name = (SELECT name FROM visits WHERE id = 7)""",
    "history_counts": f"WITH {VISITS} SELECT name, count(*) AS n_visits FROM visits GROUP BY name",
    "editable_rows": """
WITH r AS (
  SELECT o_orderkey,
    CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS signature,
    o_orderstatus = 'P' AS nurse, o_totalprice > 400000 AS lead
  FROM orders)
SELECT o_orderkey, signature,
  nurse OR signature IS NULL OR lead OR signature = '4-NOT SPECIFIED' AS can_edit FROM r""",
    "log_day": f"""
WITH {LOG} SELECT id, "timestamp", {LOG_LINE} AS line FROM log
WHERE "timestamp" >= TIMESTAMP '2024-01-10' AND "timestamp" < TIMESTAMP '2024-01-11'""",
    "daily_digest": f"""
WITH {LOG}
SELECT CAST("timestamp" AS DATE) AS log_date, "timestamp" AS ts, id, {LOG_LINE} AS line FROM log
UNION ALL
SELECT DISTINCT CAST("timestamp" AS DATE), CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT),
  'Action Logs Report for ' || strftime("timestamp", '%Y-%m-%d') FROM log""",
    "daily_digest_counts": """
SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""",
    "log_store": """
SELECT CAST(ts AS DATE) AS log_date, event_id AS id, ts AS "timestamp", event_type AS action FROM events""",
    "log_lines": """
SELECT strftime(ts, '%Y-%m-%d') AS file,
  CASE WHEN ok THEN date_trunc('second', ts) END AS ts,
  CASE WHEN ok THEN 'user_' || user_id END AS user_type,
  CASE WHEN ok THEN event_type END AS action,
  CASE WHEN ok THEN props || ', fin' END AS details,
  CASE WHEN ok THEN 'Nouvelle evenement: ' || strftime(ts, '%H:%M:%S') || ' user_' || user_id || ', '
    || event_type || ', ' || props || ', fin' ELSE 'unreadable' END AS line
FROM (SELECT *, event_type <> 'error' AS ok FROM events)""",
    "invoice_lines": """
SELECT l_orderkey, l_linenumber, l_returnflag,
  CAST(round_even(l_extendedprice * l_quantity * (100.0::DOUBLE - floor(l_discount * 100)) / 100, 0) AS BIGINT) AS net
FROM lineitem""",
    "invoice_totals": """
WITH lines AS (
  SELECT l_orderkey, l_returnflag,
    CAST(round_even(l_extendedprice * l_quantity * (100.0::DOUBLE - floor(l_discount * 100)) / 100, 0) AS BIGINT) AS net
  FROM lineitem)
SELECT l_orderkey, l_returnflag, false AS is_total, CAST(sum(net) AS BIGINT) AS amount FROM lines GROUP BY 1, 2
UNION ALL
SELECT l_orderkey, NULL, true, CAST(sum(net) AS BIGINT) FROM lines GROUP BY 1""",
    "coverage_split": f"""
WITH {ITEMS}
SELECT l_orderkey, total, CAST(trunc(total * 0.8::DOUBLE) AS BIGINT) AS insurer,
  total - CAST(trunc(total * 0.8::DOUBLE) AS BIGINT) AS patient FROM bills WHERE errors = ''""",
    "rejected_items": f"WITH {ITEMS} SELECT l_orderkey, errors FROM bills WHERE errors <> ''",
    "nested_invoice_lines": f"""
WITH {INVOICES}, lines AS (
  SELECT l_orderkey, l_linenumber, l_linestatus, pct, 0 AS section_pos, 0 AS article_pos, 'goods' AS libelle,
    goods AS net, l_extendedprice AS montant FROM priced WHERE l_quantity > 0 AND NOT odd_goods
  UNION ALL SELECT l_orderkey, l_linenumber, l_linestatus, pct, 0, CASE WHEN odd_goods THEN 0 ELSE 1 END,
    'tax', tax, l_tax * 1000 FROM priced WHERE l_tax > 0
  UNION ALL SELECT l_orderkey, l_linenumber, l_linestatus, pct, CASE WHEN has_first THEN 1 ELSE 0 END, 0,
    'rebate', rebate, 10.5 FROM priced WHERE l_discount > 0)
SELECT l_orderkey AS invoice_id, l_linenumber, section_pos, l_linestatus AS titre, article_pos, libelle, net,
  CAST(trunc(montant) AS BIGINT) || ' Fcfa' AS amount_label, CAST(100 - pct AS BIGINT) || '%' AS insurer_label
FROM lines""",
    "nested_invoice_totals": f"""
WITH {INVOICES}
SELECT l_orderkey AS invoice_id, l_linenumber,
  goods + CASE WHEN l_tax > 0 THEN tax ELSE 0 END + CASE WHEN l_discount > 0 THEN rebate ELSE 0 END AS total,
  CAST(CASE WHEN l_discount > 0 AND has_first THEN 2 ELSE 1 END AS BIGINT) AS n_sections,
  CASE WHEN has_first THEN goods + CASE WHEN l_tax > 0 THEN tax ELSE 0 END ELSE rebate END AS first_subtotal
FROM formed""",
    "raw_invoice_totals": f"""
WITH {INVOICES}
SELECT l_orderkey AS invoice_id, l_linenumber,
  2 * goods + CAST(round_even(5.0::DOUBLE * pct / 100, 0) AS BIGINT) + tax + rebate AS total
FROM priced WHERE NOT odd_goods""",
    "rejected_invoices": f"""
WITH {INVOICES}
SELECT l_orderkey AS invoice_id, l_linenumber,
  concat_ws('; ', CASE WHEN no_sections THEN 'sections are required' END,
    CASE WHEN blank_percent THEN 'pourcentage must be a number' END,
    CASE WHEN endless_percent THEN 'pourcentage must be finite' END,
    CASE WHEN too_large THEN 'amounts must be finite and not too large' END) AS errors
FROM (SELECT *, NOT no_sections AND NOT blank_percent AND NOT endless_percent AND (huge_percent OR odd_goods) AS too_large FROM docs)
WHERE no_sections OR blank_percent OR endless_percent OR too_large""",
    "validated_rows": f"""
WITH {REQUESTS} SELECT seq, {BORN} FROM req WHERE {INSERT_ERRORS} = ''""",
    "rejected_rows": f"""
WITH {REQUESTS} SELECT seq, {INSERT_ERRORS} AS errors FROM req WHERE {INSERT_ERRORS} <> ''""",
    "apply_changes": (APPLIED := f"{LIVES} SELECT id, {LIFE_COLUMNS} FROM lives WHERE ended IS NULL"),
    "stored_changes": APPLIED,
    "stream_changes": APPLIED,
    "deleted_rows": f"{LIVES} SELECT id, ended AS seq, {LIFE_COLUMNS} FROM lives WHERE ended IS NOT NULL",
    "rejected_changes": (REFUSED := f"""{LIVES}
SELECT seq, op, id, errors FROM checked WHERE errors <> ''
UNION ALL
SELECT seq, op, id, 'id exists' FROM marked WHERE op = 'insert' AND (from_stored OR seq <> start)"""),
    "stream_rejected": REFUSED,
    "running_statistics": f"""{LIVES},
final AS (SELECT name, adresse, created_at FROM lives WHERE ended IS NULL),
days AS (SELECT created_at AS day, count(*) AS n FROM final WHERE created_at IS NOT NULL GROUP BY 1),
months AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, sum(n) AS n FROM days GROUP BY 1),
all_days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 day)) AS DATE) AS day FROM days),
all_months AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 month)) AS DATE) AS month FROM months),
names AS (SELECT lower(strip_accents(trim(name))) AS name, count(*) AS n FROM final GROUP BY 1 ORDER BY n DESC, name LIMIT 8),
places AS (SELECT adresse, count(*) AS n FROM final WHERE adresse IS NOT NULL GROUP BY 1 ORDER BY n DESC, adresse LIMIT 10)
SELECT 'daily_revenue' AS kind, CAST(day AS VARCHAR) AS key, CAST(coalesce(n, 0) AS BIGINT) AS n FROM all_days LEFT JOIN days USING (day)
UNION ALL SELECT 'monthly_revenue', CAST(month AS VARCHAR), CAST(coalesce(n, 0) AS BIGINT) FROM all_months LEFT JOIN months USING (month)
UNION ALL SELECT 'top_names', {_title("name")}, n FROM names
UNION ALL SELECT 'top_addresses', adresse, n FROM places
UNION ALL SELECT 'value adresse', adresse, count(*) FROM final WHERE adresse <> '' GROUP BY adresse""",
    "notifications": (NOTIFICATIONS := f"""
WITH {REQUESTS}
SELECT seq, CASE WHEN op = 'insert' THEN 'infirmiers' ELSE 'medecins' END AS recipient_group, name AS patient_name,
  CASE WHEN op = 'insert' THEN 'new visit' ELSE 'visit updated' END AS reason
FROM req WHERE (op = 'insert' AND {INSERT_ERRORS} = '')
  OR (op = 'update' AND {UPDATE_ERRORS} = '' AND (NOT has_temperature OR temperature <> ''))"""),
    "change_log": f"""
WITH {REQUESTS}
SELECT received_at AS "timestamp", role AS user_type,
  CASE op WHEN 'insert' THEN 'Ajout d''un patient' ELSE 'modification patient' END AS action,
  CASE op WHEN 'insert' THEN 'Le patient ''' || name || ''' a été ajouté'
    ELSE 'Patient avec ID ' || id || ' a été modifié' END AS details
FROM req WHERE (op = 'insert' AND {INSERT_ERRORS} = '') OR (op = 'update' AND {UPDATE_ERRORS} = '')""",
    "deletion_log": f"""{LIVES}, images AS (
  SELECT ended, 'Le patient avec l''identifiant ' || id || ' a été supprimé. Voici les infos du patient supprimé {{'
    || concat_ws(',', '"id":' || id, '"name":"' || name || '"',
    '"adresse":"' || replace(replace(adresse, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"',
    '"phone_number":"' || phone_number || '"') || '}}' AS details FROM lives WHERE ended IS NOT NULL)
SELECT make_timestamp(ended * 1000000) AS "timestamp", 'infirmiers' AS user_type, 'Suppression d''un patient' AS action,
  md5(details) AS details_md5 FROM images""",
    "opened_records": """
SELECT ts AS "timestamp", 'infirmiers' AS user_type, 'Détails des patients' AS action,
  'Les détails du patient avec l''identifiant ' || user_id || ' ont été consulté.' AS details
FROM events WHERE event_type = 'view'""",
    "invoice_events": """
SELECT o_orderdate AS "timestamp", 'receptionistes' AS user_type, 'Facture généré' AS action,
  'Facture généré pour le patient ' || o_custkey || ' ' || coalesce(nullif(o_orderstatus, 'P'), 'None') AS details
FROM orders""",
    "orphan_rows": """
SELECT l_orderkey AS patient_id, l_partkey, l_linenumber FROM lineitem
WHERE l_returnflag <> 'N' AND NOT EXISTS (
  SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""",
    "unaccented_search": """
SELECT doc_id, lang FROM documents WHERE contains(lower(strip_accents(text)), 'une de')""",
    "unaccented_names": r"""
SELECT lower(strip_accents(w)) AS word, count(*) AS n
FROM (SELECT split_part(text, ' ', 1) AS w FROM documents) WHERE regexp_full_match(w, '\p{L}+') GROUP BY 1""",
    "stream_closed_days": f"""
WITH last AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events),
closed AS (SELECT * FROM ({_series("day").replace("orders", "events").replace("o_orderdate", "ts")}), last)
SELECT day, n, revenue FROM closed WHERE day + INTERVAL 1 DAY <= mark""",
    "stream_digest": f"""
WITH {LOG}, days AS (
  SELECT DISTINCT CAST("timestamp" AS DATE) AS log_date FROM log
  WHERE CAST("timestamp" AS DATE) + INTERVAL 1 DAY <= (SELECT max("timestamp") - INTERVAL 1 DAY FROM log))
SELECT log_date, {LOG_LINE} AS line FROM log JOIN days ON CAST("timestamp" AS DATE) = log_date
UNION ALL
SELECT log_date, 'Action Logs Report for ' || strftime(log_date, '%Y-%m-%d') FROM days""",
    "observed_fields": (REQUIRED := """
SELECT 'id' AS field, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_missing FROM orders
UNION ALL SELECT 'action', count(*) FILTER (WHERE o_orderstatus = 'P' OR o_orderstatus IS NULL) FROM orders
UNION ALL SELECT 'name', count(*) FILTER (WHERE o_orderpriority = '5-LOW' OR o_orderpriority IS NULL) FROM orders"""),
    "required_fields": REQUIRED,
    "accent_fold": r"""
WITH folded AS (
  SELECT doc_id, strip_accents(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS folded FROM documents)
SELECT doc_id, length(folded) AS n_chars_folded, md5(folded) AS folded_md5, md5(lower(folded)) AS lower_md5 FROM folded""",
    "text_preview": r"""
WITH w AS (SELECT doc_id, text, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ') AS words FROM documents)
SELECT doc_id, CASE WHEN length(text) > 30 THEN left(text, 30) || '...' ELSE text END AS preview,
  words[-1] AS nom, md5(array_to_string(words[1:-2], ' ')) AS prenom_md5 FROM w""",
    "title_names": f"SELECT p_partkey, {_title('p_name')} AS name FROM part",
    "display_users": """
SELECT conv_id, turn,
  CASE role WHEN 'user' THEN 'receptioniste' WHEN 'assistant' THEN 'infirmier'
    ELSE 'Dr ' || role || ' ' || conv_id END AS shown_user,
  CASE role WHEN 'assistant' THEN role ELSE 'N/A' END AS shown_details
FROM conversations""",
    "age_fields": """
WITH p AS (
  SELECT event_id, CAST(user_id AS INTEGER) AS y,
    CASE WHEN value < 5 THEN 0 ELSE CAST(floor(value / 50) AS INTEGER) END AS m, CAST(floor(value) AS INTEGER) AS d
  FROM events),
a AS (SELECT *, round_even(y + m / 12.0::DOUBLE + d / 365.0::DOUBLE, 10) AS age FROM p),
f AS (SELECT *, (age - floor(age)) * 12 AS months FROM a)
SELECT event_id, age, CAST(floor(age) AS BIGINT) AS whole_years, CAST(floor(months) AS BIGINT) AS whole_months,
  CAST(floor((months - floor(months)) * 30) AS BIGINT) AS whole_days,
  CASE WHEN age = 0 THEN '' ELSE concat_ws(' ', CASE WHEN y <> 0 THEN y || ' ans' END,
    CASE WHEN m <> 0 THEN m || ' mois' END, CASE WHEN d <> 0 THEN d || ' jours' END) END AS age_label
FROM f""",
    "unit_labels": """
WITH v AS (SELECT event_id, CASE WHEN event_type = 'view' THEN floor(value) ELSE value END AS v FROM events)
SELECT event_id, CASE WHEN v = 0 THEN '' WHEN v = floor(v) THEN CAST(v AS BIGINT) || ' kg' ELSE v || ' kg' END AS weight
FROM v""",
    "parsed_numbers": """
SELECT event_id,
  CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN NULL
    WHEN 'signup' THEN CAST(value::VARCHAR || 'e2' AS DOUBLE) ELSE value END AS number,
  event_type = 'error' AS refused FROM events""",
    "date_labels": f"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS timestamp_label,
  strftime(o_orderdate, '%Y-%m-%d') AS day_label, strftime(o_orderdate, '%d/%m/%Y') AS french_day,
  strftime(o_orderdate, '%d/%m/%Y %H:%M') AS french_minute,
  {MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) AS french_month,
  CAST(trunc(o_totalprice) AS BIGINT) || ' Fcfa' AS amount,
  'facture_Nom_' || o_orderstatus || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.pdf' AS invoice_name
FROM orders""",
    "stream_daily": """
WITH counts AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM counts)
SELECT spine.day, coalesce(n, 0) AS n, coalesce(n, 0) * 10000 AS revenue FROM spine LEFT JOIN counts USING (day)""",
    "stream_log": f"""
WITH {LOG} SELECT CAST("timestamp" AS DATE) AS log_date, id, "timestamp", user_type, action, details FROM log""",
    "stream_notifications": NOTIFICATIONS,
}
