"""Registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.columns import compute_once
from visitbook.functions import fields, labels, text
from visitbook.operators import access, audit, changes, distribution, history, ingest, invoice, quality, search, series, text_index
from visitbook.plans import requests as plans
from visitbook.plans import stand_ins
from visitbook.plans.stand_ins import table
from visitbook.schemas import NURSES, PHYSICIANS, RECEPTIONISTS
from visitbook.session import configure, scratch_dir
from visitbook.sources import logs, running_counts, table_store, visit_layout
from visitbook.sources.visits import normalize_visits
from visitbook.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Columns compared for whole visit rows.
VISIT_COLUMNS = [
    "name", "adresse", "age", "date_of_birth", "poids", "temperature", "signature", "created_at",
    "age_years", "age_months", "age_days", "phone_number",
]


def query(f: Query) -> Query:
    """Register a query, which sets its session up once."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(configure(spark), sf_dir)
    return f


# --- series -------------------------------------------------------------------


@query
def daily_revenue(spark, sf_dir):
    return series.with_revenue(series.daily_visits(table(spark, sf_dir, "orders"), "o_orderdate"))


@query
def monthly_revenue(spark, sf_dir):
    return series.with_revenue(series.monthly_visits(table(spark, sf_dir, "orders"), "o_orderdate"))


@query
def date_bounds(spark, sf_dir):
    return series.bounds(table(spark, sf_dir, "orders"), "o_orderdate")


# --- frequencies ----------------------------------------------------------------


@query
def top_names(spark, sf_dir):
    return distribution.top_names(stand_ins.parts(spark, sf_dir))


@query
def top_addresses(spark, sf_dir):
    return distribution.top_addresses(stand_ins.visits(spark, sf_dir))


@query
def value_distribution(spark, sf_dir):
    visits = stand_ins.visits(spark, sf_dir).select(
        "adresse",
        F.when(F.col("status") != "P", F.col("status")).alias("sexe"),
        F.when(F.col("signature") == "5-LOW", F.lit("")).otherwise(F.col("signature")).alias("groupe_sanguin"),
    )
    return distribution.value_distribution(visits, ["adresse", "sexe", "groupe_sanguin"])


@query
def histogram_value(spark, sf_dir):
    return distribution.histogram(table(spark, sf_dir, "events"), "value")


# --- search, history, access ------------------------------------------------------


@query
def search_parts(spark, sf_dir):
    return search.search(stand_ins.parts(spark, sf_dir), "AN")


@query
def search_wildcard(spark, sf_dir):
    return search.search(stand_ins.parts(spark, sf_dir), "r_d%g")


@query
def search_many(spark, sf_dir):
    return search.search_many(stand_ins.parts(spark, sf_dir), ["ring", "ECO", "b%t", "zzz", ""])


def _indexed(spark, sf_dir):
    """The parts and an index of their texts."""
    parts = stand_ins.parts(spark, sf_dir)
    index = text_index.TextIndex(scratch_dir(spark, "index"))
    text_index.write_index(parts, index)
    return parts, index


@query
def indexed_search(spark, sf_dir):
    return text_index.search_indexed(*_indexed(spark, sf_dir), "L_wid%ET")


@query
def search_table(spark, sf_dir):
    """A query cut from every part's name, some of them with wildcards, all answered at once."""
    parts, index = _indexed(spark, sf_dir)
    return text_index.search_queries(parts, index, stand_ins.part_queries(parts)).select("id", "q")


@query
def unaccented_search(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return search.search_unaccented(documents, "UNE DE", ("text",)).select("doc_id", "lang")


@query
def unaccented_names(spark, sf_dir):
    """First words of the texts, counted by collation."""
    words = table(spark, sf_dir, "documents").select(F.substring_index("text", " ", 1).alias("word")).where(r"word RLIKE '^\\p{L}+$'")
    counted = distribution.unaccented_counts(words, "word")
    return counted.select(text.fold_name(F.col("word")).alias("word"), "n")


@query
def visits_by_id(spark, sf_dir):
    viewed = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return search.by_ids(stand_ins.visits(spark, sf_dir), viewed).select("id", "name", "created_at")


@query
def visit_by_id(spark, sf_dir):
    """Looking up one visit is the feature."""
    return search.by_id(stand_ins.visits(spark, sf_dir), 7).select("id", "name", "created_at")


@query
def latest_visits(spark, sf_dir):
    return plans.listing(plans.conform(stand_ins.visits(spark, sf_dir)), "", RECEPTIONISTS)


@query
def search_listing(spark, sf_dir):
    return plans.listing(plans.conform(stand_ins.visits(spark, sf_dir)), "auto", PHYSICIANS, 50)


@query
def nurse_columns(spark, sf_dir):
    visits = plans.conform(stand_ins.visits(spark, sf_dir))
    return access.display_labels(access.project_for_role(visits, NURSES))


@query
def visit_history(spark, sf_dir):
    visits = stand_ins.visits(spark, sf_dir)
    viewed = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return history.visit_history(visits, viewed).select("name", "id", "created_at", "n_visits")


def _laid_out(spark, sf_dir):
    """The visits by month and bucket of names, as a table of the catalog."""
    path = scratch_dir(spark, "visits")
    name = "visits_" + path.rsplit("-", 1)[1]
    visit_layout.store_visits(stand_ins.visits(spark, sf_dir), name, path, buckets=4)
    return name


@query
def laid_out_history(spark, sf_dir):
    viewed = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    found = visit_layout.history_in_buckets(spark, _laid_out(spark, sf_dir), viewed)
    return found.select("name", "id", "created_at", "n_visits")


@query
def laid_out_revenue(spark, sf_dir):
    """Daily revenue of a span of days, from the months it touches."""
    visits = visit_layout.between(spark.table(_laid_out(spark, sf_dir)), "1995-03-20", "1995-05-10")
    return series.with_revenue(series.daily_visits(visits))


@query
def history_of_one(spark, sf_dir):
    """The history page of one visit."""
    return history.history_of(stand_ins.visits(spark, sf_dir), 7).select("id", "name", "created_at")


@query
def history_counts(spark, sf_dir):
    return history.history_counts(stand_ins.visits(spark, sf_dir))


@query
def editable_rows(spark, sf_dir):
    """Users of all roles against signed, unsigned and empty rows."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(priority == "5-LOW", F.lit("")).when(priority != "3-MEDIUM", priority).alias("signature"),
        F.when(status == "P", F.lit(NURSES)).otherwise(F.lit(PHYSICIANS)).alias("role"),
        F.when(F.col("o_totalprice") > 400000, F.lit("lead_user")).otherwise(F.lit("4-NOT_SPECIFIED")).alias("username"),
    )
    checked = access.editable_by(rows, F.col("role"), F.col("username"), "lead_user")
    return checked.select("o_orderkey", "signature", "can_edit")


# --- audit log ------------------------------------------------------------------


def _log(spark, sf_dir):
    return stand_ins.log(table(spark, sf_dir, "events"))


@query
def log_day(spark, sf_dir):
    day = audit.log_order(audit.log_range(_log(spark, sf_dir), "2024-01-10"))
    line = labels.log_line(F.col("user_type"), F.col("action"), F.col("details"))
    return day.select("id", "timestamp", line.alias("line"))


@query
def daily_digest(spark, sf_dir):
    return audit.daily_digest(_log(spark, sf_dir))


@query
def daily_digest_counts(spark, sf_dir):
    """Events of every day's report: its lines without the header."""
    events = audit.daily_digest(_log(spark, sf_dir)).where(F.col("ts").isNotNull())
    return events.groupBy(F.col("log_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def log_store(spark, sf_dir):
    path = scratch_dir(spark, "log")
    logs.write_log(_log(spark, sf_dir), path)
    return logs.read_log(spark, path).select("log_date", "id", "timestamp", "action")


@query
def log_lines(spark, sf_dir):
    """Events written as text log lines under a header per day, and parsed again."""
    events = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd").alias("file")
    event_line = F.concat(
        F.lit("Nouvelle evenement: "), F.date_format("ts", "HH:mm:ss"), F.lit(" user_"),
        F.col("user_id").cast("string"), F.lit(", "), F.col("event_type"), F.lit(", "), F.col("props"), F.lit(", fin"),
    )
    line = F.when(F.col("event_type") == "error", F.lit("unreadable")).otherwise(event_line)
    lines = events.select(day, (F.col("event_id") + 1).alias("line_no"), line.alias("line"))
    headers = events.select(day).distinct().select("file", F.lit(0).cast("bigint").alias("line_no"), F.col("file").alias("line"))
    return logs.parse_log_lines(headers.unionByName(lines))


# --- invoices -------------------------------------------------------------------


@query
def invoice_lines(spark, sf_dir):
    percent = F.lit(100.0) - F.floor(F.col("l_discount") * 100)
    net = invoice.net_amount(F.col("l_extendedprice"), F.col("l_quantity"), percent)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", net.alias("net"))


@query
def invoice_totals(spark, sf_dir):
    return invoice.line_totals(invoice_lines(spark, sf_dir), "l_orderkey", "l_returnflag")


def _checked_items(spark, sf_dir):
    return invoice.check_items(stand_ins.items(spark, sf_dir), "l_orderkey", "quantity", "price")


@query
def coverage_split(spark, sf_dir):
    return invoice.coverage_split(_checked_items(spark, sf_dir))


@query
def rejected_items(spark, sf_dir):
    """Bills that cannot be split, with what is wrong with them."""
    return invoice.rejected_invoices(_checked_items(spark, sf_dir)).select(
        "l_orderkey", F.array_join("errors", "; ").alias("errors")
    )


def _priced(spark, sf_dir):
    checked = invoice.check_invoices(stand_ins.invoices(spark, sf_dir), form=True)
    return invoice.price(invoice.keep_valid_articles(invoice.accepted_invoices(checked)))


@query
def nested_invoice_lines(spark, sf_dir):
    lines = invoice.invoice_lines(_priced(spark, sf_dir), "invoice_id", "l_linenumber")
    return lines.select(
        "invoice_id", "l_linenumber", "section_pos", "titre", "article_pos", "libelle", "net",
        labels.money_label(F.col("montant")).alias("amount_label"),
        labels.insurer_label(F.col("patient_percent")).alias("insurer_label"),
    )


@query
def nested_invoice_totals(spark, sf_dir):
    return invoice.with_totals(_priced(spark, sf_dir)).select(
        "invoice_id", "l_linenumber", "total",
        F.size("subtotals").cast("bigint").alias("n_sections"),
        F.get("subtotals", F.lit(0))["subtotal"].alias("first_subtotal"),
    )


@query
def raw_invoice_totals(spark, sf_dir):
    """Totals of the documents as sent, where missing parts take their defaults."""
    checked = invoice.check_invoices(stand_ins.invoices(spark, sf_dir))
    priced = invoice.price(invoice.accepted_invoices(checked))
    return invoice.with_totals(priced).select("invoice_id", "l_linenumber", "total")


@query
def rejected_invoices(spark, sf_dir):
    checked = invoice.check_invoices(stand_ins.invoice_texts(spark, sf_dir))
    return invoice.rejected_invoices(checked).select(
        "invoice_id", "l_linenumber", F.array_join("errors", "; ").alias("errors")
    )


# --- ingest and changes -----------------------------------------------------------


def _requests(spark, sf_dir):
    return stand_ins.requests(table(spark, sf_dir, "events"))


@query
def validated_rows(spark, sf_dir):
    checked = ingest.check_inserts(_requests(spark, sf_dir), F.col("received_at"))
    return ingest.to_rows(ingest.accepted(checked), "seq").select("seq", *VISIT_COLUMNS)


@query
def rejected_rows(spark, sf_dir):
    checked = ingest.check_inserts(_requests(spark, sf_dir), F.col("received_at"))
    return ingest.rejected(checked).select("seq", F.array_join("errors", "; ").alias("errors"))


def _applied(spark, sf_dir):
    base = normalize_visits(plans.conform(stand_ins.visits(spark, sf_dir)))
    return changes.apply_changes(base, _requests(spark, sf_dir), F.col("received_at"))


@query
def apply_changes(spark, sf_dir):
    return _applied(spark, sf_dir).rows.select("id", *VISIT_COLUMNS)


@query
def deleted_rows(spark, sf_dir):
    return _applied(spark, sf_dir).deleted.select("id", "seq", *VISIT_COLUMNS)


@query
def rejected_changes(spark, sf_dir):
    return _applied(spark, sf_dir).rejected.select("seq", "op", "id", F.array_join("errors", "; ").alias("errors"))


# Buckets of the stand-in's stored table, and triggers of streams that arrive in parts.
BUCKETS, TRIGGERS = 16, 3


def _stored(spark, sf_dir, label):
    """The visits as a stored table of their own."""
    table_ = table_store.StoredTable(scratch_dir(spark, label), BUCKETS)
    base = normalize_visits(plans.conform(stand_ins.visits(spark, sf_dir)))
    table_store.create_table(spark, table_, base)
    return table_


@query
def stored_changes(spark, sf_dir):
    """The batch applied to the stored table by rewriting the buckets it names."""
    stored = _stored(spark, sf_dir, "stored")
    applied = table_store.apply_batch(spark, stored, _requests(spark, sf_dir), 1, F.col("received_at"))
    return applied.rows.select("id", *VISIT_COLUMNS)


def _streamed(spark, sf_dir, count=False):
    """The requests as a stream of several triggers, applied to the stored table."""
    stored = _stored(spark, sf_dir, "streamed")
    if count:
        running_counts.record_counts(spark, stored, 0)
    requests = stand_ins.requests(stand_ins.stream_in_parts(spark, sf_dir, "events", "event_id", TRIGGERS))
    checkpoint = scratch_dir(spark, "streamed-checkpoint")
    jobs.stream_changes(requests, stored, checkpoint, F.col("received_at"), count=count).awaitTermination()
    return stored


@query
def stream_changes(spark, sf_dir):
    return table_store.read_table(spark, _streamed(spark, sf_dir)).select("id", *VISIT_COLUMNS)


@query
def stream_rejected(spark, sf_dir):
    """What the triggers refused."""
    refused = table_store.read_outcomes(spark, _streamed(spark, sf_dir), "rejected")
    return refused.select("seq", "op", "id", F.array_join("errors", "; ").alias("errors"))


@query
def running_statistics(spark, sf_dir):
    """Statistics after the stream of changes, from the counts kept beside the table."""
    stored = _streamed(spark, sf_dir, count=True)
    found = running_counts.running_statistics(running_counts.read_counts(spark, stored))
    shown = lambda kind, key: found[kind].select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "n")
    return (
        shown("daily_revenue", "day").unionByName(shown("monthly_revenue", "month")).unionByName(shown("top_names", "name"))
        .unionByName(shown("top_addresses", "adresse"))
        .unionByName(found["value_distribution"].select(F.concat(F.lit("value "), "column").alias("kind"), F.col("value").alias("key"), "n"))
    )


@query
def notifications(spark, sf_dir):
    return changes.notifications(changes.judge_changes(_requests(spark, sf_dir)))


@query
def change_log(spark, sf_dir):
    checked = changes.check_changes(_requests(spark, sf_dir), F.col("received_at"))
    return changes.change_log(ingest.accepted(checked), F.col("received_at"))


@query
def deletion_log(spark, sf_dir):
    """The deleted rows of the applied batch; their images are compared by their digest."""
    deleted = _applied(spark, sf_dir).deleted.select("seq", "id", "name", "adresse", "phone_number")
    at = F.timestamp_seconds("seq").cast("timestamp_ntz")
    events = changes.deletion_log(deleted, at, F.lit(NURSES))
    return events.select("timestamp", "user_type", "action", F.md5("details").alias("details_md5"))


@query
def opened_records(spark, sf_dir):
    """Every view in the log as an opened record."""
    views = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return changes.event_log(views, "details", F.col("ts"), F.lit(NURSES), F.col("user_id"))


@query
def invoice_events(spark, sf_dir):
    """Every order as a priced invoice; some patients have no first name."""
    first = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return changes.event_log(
        table(spark, sf_dir, "orders"), "invoice", F.col("o_orderdate"), F.lit(RECEPTIONISTS), F.col("o_custkey"), first
    )


@query
def orphan_rows(spark, sf_dir):
    reference = F.when(F.col("l_returnflag") != "N", F.col("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select(reference.alias("patient_id"), "l_partkey", "l_linenumber")
    finished = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return quality.orphan_visits(lines, finished, "patient_id", "o_orderkey")


@query
def required_fields(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("action"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("name"),
    )
    return quality.required_field_report(orders, ["id", "action", "name"])


@query
def observed_fields(spark, sf_dir):
    """Missing fields, counted while the table is written."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("action"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("name"),
    )
    return quality.write_observed(orders, scratch_dir(spark, "observed"), ["id", "action", "name"])


# --- scalar functions -------------------------------------------------------------


@query
def accent_fold(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    folded = F.col("folded")
    return compute_once(documents, {"folded": text.strip_accents(text.strip_ws(F.col("text")))}).select(
        "doc_id",
        F.char_length(folded).cast("bigint").alias("n_chars_folded"),
        F.md5(folded).alias("folded_md5"),
        F.md5(F.lower(folded)).alias("lower_md5"),
    )


@query
def text_preview(spark, sf_dir):
    nom, prenom = text.split_name(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.ellipsis(F.col("text")).alias("preview"), nom.alias("nom"), F.md5(prenom).alias("prenom_md5")
    )


@query
def title_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.col("p_name")).alias("name"))


@query
def display_users(spark, sf_dir):
    speaker = F.col("role")
    role = F.when(speaker == "user", RECEPTIONISTS).when(speaker == "assistant", NURSES).otherwise(PHYSICIANS)
    username = F.concat(F.lit("Dr_"), speaker, F.lit("_"), F.col("conv_id").cast("string"))
    details = F.when(speaker == "system", F.lit("")).when(speaker == "assistant", F.col("role"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        text.display_user(role, username).alias("shown_user"),
        text.default_text(details, "N/A").alias("shown_details"),
    )


@query
def age_fields(spark, sf_dir):
    years = fields.age_part(F.col("user_id").cast("string"))
    months = fields.age_part(F.when(F.col("value") < 5, F.lit("")).otherwise(F.floor(F.col("value") / 50).cast("string")))
    days = fields.age_part(F.floor("value").cast("string"))
    parsed = table(spark, sf_dir, "events").select("event_id", years.alias("y"), months.alias("m"), days.alias("d"))
    aged = parsed.withColumn("age", fields.age_in_years(F.col("y"), F.col("m"), F.col("d")))
    whole_years, whole_months, whole_days = fields.age_parts(F.col("age"))
    return aged.select(
        "event_id", "age",
        whole_years.alias("whole_years"), whole_months.alias("whole_months"), whole_days.alias("whole_days"),
        labels.age_label(F.col("age"), F.col("y"), F.col("m"), F.col("d")).alias("age_label"),
    )


@query
def unit_labels(spark, sf_dir):
    value = F.when(F.col("event_type") == "view", F.floor("value").cast("double")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", labels.unit_label(value, "kg").alias("weight"))


@query
def parsed_numbers(spark, sf_dir):
    kind, number = F.col("event_type"), F.col("value").cast("string")
    raw = (
        F.when(kind == "view", F.concat(F.lit(" "), number, F.lit("\t")))
        .when(kind == "error", F.concat(number, F.lit("kg")))
        .when(kind == "click", F.lit(""))
        .when(kind == "signup", F.concat(number, F.lit("e2")))
        .otherwise(number)
    )
    parsed = fields.parse_float(raw)
    return table(spark, sf_dir, "events").select(
        "event_id", parsed.alias("number"), fields.not_parsed(raw, parsed).alias("refused")
    )


@query
def date_labels(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        labels.timestamp_label(at).alias("timestamp_label"),
        labels.day_label(at).alias("day_label"),
        labels.french_day_label(at).alias("french_day"),
        labels.french_minute_label(at).alias("french_minute"),
        labels.french_month_label(at).alias("french_month"),
        labels.money_label(F.col("o_totalprice")).alias("amount"),
        labels.invoice_name(F.lit("Nom"), F.col("o_orderstatus"), at).alias("invoice_name"),
    )


# --- streaming ------------------------------------------------------------------


@query
def stream_daily(spark, sf_dir):
    out = scratch_dir(spark, "daily")
    events = stand_ins.stream(spark, sf_dir, "events")
    jobs.stream_daily_visits(events, f"{out}/table", f"{out}/checkpoint", "ts").awaitTermination()
    return jobs.read_daily_series(spark, f"{out}/table")


@query
def stream_log(spark, sf_dir):
    out = scratch_dir(spark, "log")
    events = stand_ins.log(stand_ins.stream(spark, sf_dir, "events"))
    jobs.stream_log(events, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return logs.read_log(spark, f"{out}/table").select("log_date", "id", "timestamp", "user_type", "action", "details")


@query
def stream_notifications(spark, sf_dir):
    out = scratch_dir(spark, "notifications")
    requests = stand_ins.requests(stand_ins.stream(spark, sf_dir, "events"))
    jobs.stream_notifications(requests, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("seq", "recipient_group", "patient_name", "reason")


@query
def stream_closed_days(spark, sf_dir):
    out = scratch_dir(spark, "closed")
    events = stand_ins.stream_in_parts(spark, sf_dir, "events", "event_id", TRIGGERS)
    for job in jobs.stream_closed_days(events, f"{out}/table", f"{out}/checkpoint", "ts"):
        job.awaitTermination()
    return jobs.read_closed_series(spark, f"{out}/table")


@query
def stream_digest(spark, sf_dir):
    out = scratch_dir(spark, "digest")
    events = stand_ins.log(stand_ins.stream_in_parts(spark, sf_dir, "events", "event_id", TRIGGERS))
    jobs.stream_log(events, f"{out}/log", f"{out}/log-checkpoint").awaitTermination()
    jobs.stream_digest(spark, f"{out}/log", f"{out}/digests", f"{out}/checkpoint").awaitTermination()
    return jobs.read_digests(spark, f"{out}/digests")
