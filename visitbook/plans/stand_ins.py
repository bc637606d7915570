"""The driver's tables in the roles of the clinic's tables.

visits    orders with their customer       log       events
requests  events read as form submissions  invoices  one document per line item
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.columns import compute_once
from visitbook.schemas import INVOICE_META, NURSES, PHYSICIANS, RECEPTIONISTS
from visitbook.session import scratch_dir
from visitbook.sources.invoices import parse_invoices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. A stream reads a folder, so the file is picked by its name."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


# Bytes of a row group in the files of a stream in parts: what one task of a trigger reads.
ROW_GROUP = 1 << 20


def stream_in_parts(spark: SparkSession, sf_dir: str, name: str, key: str, parts: int) -> DataFrame:
    """A table as a stream of several triggers, in order of a key: one file after the other.

    The table is read in parallel; a file has small row groups, so a trigger reads its one file in
    parallel as well.
    """
    rows, folder = table(spark, sf_dir, name), scratch_dir(spark, f"parts-{name}")
    low, high = rows.agg(F.min(key), F.max(key)).first()
    width = ((high or 0) - (low or 0)) // parts + 1
    for k in range(parts):
        part = rows.where(F.floor((F.col(key) - F.lit(low)) / width) == k)
        part.repartition(1).write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("adresse"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("signature"),
        F.col("o_orderstatus").alias("status"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("adresse"), "p_brand"
    )


def part_queries(parts: DataFrame) -> DataFrame:
    """Pieces of one to nine letters of the parts' names as search queries; some with wildcards."""
    start, size = F.col("id") % 5 + 1, F.col("id") % 9 + 1
    piece = F.substr("name", start.cast("int"), size.cast("int"))
    kind = F.col("id") % 4
    return parts.select(
        F.when(kind == 1, F.upper(piece)).when(kind == 2, F.replace(piece, F.lit("e"), F.lit("_")))
        .when(kind == 3, F.concat(piece, F.lit("%"), F.right("adresse", F.lit(2)))).otherwise(piece).alias("q")
    )


def log(events: DataFrame) -> DataFrame:
    """Events as audit log; some users and details are missing or empty."""
    kind = F.col("event_type")
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.when(kind == "view", F.lit("")).when(kind != "error", user).alias("user_type"),
        kind.alias("action"),
        F.when(kind != "signup", F.col("props")).alias("details"),
    )


def requests(events: DataFrame) -> DataFrame:
    """Events as change requests, with the mistakes that submissions contain."""
    kind, value = F.col("event_type"), F.col("value")
    between = lambda low, high: (value >= low) & (value < high)

    def entry(name: str, text: Column, when: Column | None = None) -> Column:
        pair = F.struct(F.lit(name).alias("key"), text.alias("value"))
        return pair if when is None else F.when(when, pair)

    day = F.date_format("ts", "yyyy-MM-dd")
    user = F.col("user_id").cast("string")
    name = F.when(between(1, 2), F.lit("")).otherwise(F.concat(F.lit("Name "), user))
    adresse = F.when(kind == "view", F.lit("")).otherwise(F.col("props"))
    birth = F.when(value < 8, F.lit("")).when(value < 9, F.lit("31/12/1990")).otherwise(day)
    years = F.when((kind == "click") & (value < 3), F.lit("")).otherwise(user)
    months = F.when(value < 1, F.lit("")).when(between(4, 5), F.lit("12.5")).otherwise(F.lit("6"))
    weight = F.when(between(5, 6), F.lit("abc")).when(between(6, 7), F.lit("")).otherwise(value.cast("string"))
    temperature = F.when(value < 3, F.lit("")).when(value < 4, F.lit("hot")).otherwise(F.lit("38.5"))
    entries = [
        entry("name", name),
        entry("adresse", adresse, kind != "purchase"),
        entry("date_of_birth", birth, kind == "signup"),
        entry("age_years", years),
        entry("age_months", months),
        entry("age_days", F.lit("10"), value <= 150),
        entry("poids", weight, kind != "error"),
        entry("temperature", temperature, kind != "purchase"),
        entry("phone_number", F.lit(""), kind == "click"),
        entry("surname", F.lit("x"), value > 200),
    ]
    fields = F.map_from_entries(F.array_compact(F.array(*entries)))
    return compute_once(events, {"fields": fields}).select(
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "insert").when(kind == "error", "delete").otherwise("update").alias("op"),
        F.col("user_id").alias("id"),
        F.when(value < 5, PHYSICIANS).when(value < 15, NURSES).otherwise(RECEPTIONISTS).alias("role"),
        F.concat(F.lit("Dr_User_"), user).alias("username"),
        "fields",
        F.col("ts").alias("received_at"),
    )


# Texts that read as numbers, but as none that can be priced.
ODD = ("nan", "inf", "1e300")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as positions of a bill, in grouped digits; some are unreadable, missing or huge."""
    whole, part = F.floor("l_extendedprice"), F.col("l_partkey")
    spaced = F.concat(F.floor(whole / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"))
    quantity = F.col("l_quantity").cast("int").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(part % 97 == 0, "abc").when(part % 103 == 0, "4 000 000 000").when(part % 107 != 0, quantity).alias("quantity"),
        F.when(part % 101 == 0, "").when(part % 103 == 0, "4000000000").when(part % 109 != 0, spaced).alias("price"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a nested invoice: valid and invalid articles, a blank section, a
    repeated title, documents without sections or with a blank percentage.
    """
    status = F.col("l_linestatus")

    def odd(m: int) -> Column:
        """Numbers that read but cannot be priced, for every m-th part."""
        return F.when(F.col("l_partkey") % m == 0, F.element_at(F.array(*map(F.lit, ODD)), F.pmod("l_linenumber", F.lit(3)) + 1))

    def article(label: str, quantity: Column, amount: Column) -> Column:
        number = [quantity.cast("double").cast("string"), amount.cast("double").cast("string")]
        return F.struct(F.lit(label).alias("libelle"), number[0].alias("quantite"), number[1].alias("montant"))

    def section(title: Column, *articles: Column) -> Column:
        return F.struct(title.alias("titre"), F.array(*articles).alias("articles"))

    goods = article(" goods ", F.col("l_quantity"), F.col("l_extendedprice"))
    goods = F.struct(
        goods["libelle"].alias("libelle"), F.coalesce(odd(97), goods["quantite"]).alias("quantite"),
        F.coalesce(odd(101), goods["montant"]).alias("montant"),
    )
    tax = article("tax", F.when(F.col("l_tax") > 0, F.lit(1)), F.col("l_tax") * 1000)
    sections = F.array(
        section(status, goods, article("", F.lit(1), F.lit(5)), tax),
        section(F.lit("  "), goods),
        section(status, article("rebate", F.col("l_discount") * 100, F.lit(10.5))),
    )
    percent = F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_discount") * 100).cast("string")).when(
        (F.col("l_returnflag") == "N") & (status == "F"), F.lit("")
    )
    percent = F.when(F.col("l_partkey") % 89 == 0, odd(89)).otherwise(percent)
    meta = F.struct(*[
        {"nom": F.lit("Client"), "pourcentage": percent}.get(f.name, F.lit(None).cast("string")).alias(f.name)
        for f in INVOICE_META
    ])
    return table(spark, sf_dir, "lineitem").select(
        "l_linenumber",
        F.col("l_orderkey").alias("invoice_id"),
        meta.alias("meta"),
        F.when(F.col("l_linenumber") < 7, sections).alias("sections"),
    )


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same invoices as JSON text, parsed."""
    nested = invoices(spark, sf_dir)
    text = F.to_json(F.struct("invoice_id", "meta", "sections"))
    return parse_invoices(nested.select("l_linenumber", text.alias("text")), F.col("text"), "l_linenumber")
