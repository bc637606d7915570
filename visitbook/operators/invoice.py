"""Nested invoices: validity, priced lines, subtotals and totals, insurer share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitbook.columns import compute_once, present
from visitbook.functions.fields import is_finite, parse_float, round_half_even, spaced_int
from visitbook.functions.text import browser_trim
from visitbook.schemas import INSURER_SHARE

# What missing parts of an invoice count as.
DEFAULT_TITLE, DEFAULT_LABEL, DEFAULT_QUANTITY, DEFAULT_AMOUNT = "Section", "", 1.0, 0.0

# What the net amounts of a document may add up to, without regard to signs: a bigint.
LARGEST_TOTAL = float(1 << 62)


def check_invoices(invoices: DataFrame, form: bool = False) -> DataFrame:
    """Numbers for the text of a document, and `errors`: what keeps it from being priced.

    Adds patient_percent and turns quantities and amounts into numbers. A document
    without errors can be priced; one that cannot is refused alone. Percentages,
    quantities and amounts must be finite, and the net amounts must fit a bigint, summed
    up as well. With `form` the articles are still to pass `keep_valid_articles`, which
    drops those whose quantity or amount is NaN; without it they refuse the document.
    """
    percent = parse_float(F.col("meta.pourcentage"))

    def read_numbers(a: Column) -> Column:
        return F.struct(
            a.alias("raw"), parse_float(a["quantite"]).alias("quantite"), parse_float(a["montant"]).alias("montant")
        )

    def article(a: Column) -> Column:
        raw, quantity, amount = a["raw"], a["quantite"], a["montant"]
        bad = (raw["quantite"].isNotNull() & quantity.isNull()) | (raw["montant"].isNotNull() & amount.isNull())
        return F.struct(
            raw["libelle"].alias("libelle"), quantity.alias("quantite"), amount.alias("montant"), bad.alias("bad")
        )

    def section(s: Column) -> Column:
        articles = F.transform(F.transform(s["articles"], read_numbers), article)
        return F.struct(s["titre"].alias("titre"), articles.alias("articles"))

    # An absent percentage counts as 0, a blank one is an error.
    share = F.when(F.col("meta.pourcentage").isNull(), F.lit(100.0)).otherwise(100 - percent)
    read = compute_once(invoices, {"patient_percent": share, "sections": F.transform("sections", section)})
    bad_number = F.exists("sections", lambda s: F.exists(s["articles"], lambda a: a["bad"]))

    def size(a: Column) -> Column:
        quantity = F.coalesce(a["quantite"], F.lit(DEFAULT_QUANTITY))
        net = F.abs(F.coalesce(a["montant"], F.lit(DEFAULT_AMOUNT)) * quantity * F.col("patient_percent") / 100)
        dropped = F.isnan(quantity) | F.isnan(a["montant"])
        return F.when(F.coalesce(dropped, F.lit(False)), F.lit(0.0)).otherwise(net) if form else net

    def add_section(sum: Column, s: Column) -> Column:
        return F.coalesce(F.aggregate(s["articles"], sum, lambda total, a: total + size(a)), sum)

    total = F.aggregate("sections", F.lit(0.0), add_section)
    too_large = is_finite(F.col("patient_percent")) & ~(total < LARGEST_TOTAL)
    errors = present([
        F.when(F.col("meta").isNull(), F.lit("meta is required")),
        F.when(F.col("sections").isNull(), F.lit("sections are required")),
        F.when(F.col("patient_percent").isNull(), F.lit("pourcentage must be a number")),
        F.when(~is_finite(F.col("patient_percent")), F.lit("pourcentage must be finite")),
        F.when(bad_number, F.lit("quantite and montant must be numbers")),
        F.when(too_large, F.lit("amounts must be finite and not too large")),
    ])
    return read.withColumn("errors", errors)


def accepted_invoices(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def rejected_invoices(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def keep_valid_articles(accepted: DataFrame) -> DataFrame:
    """What a form may submit: labelled articles with quantity > 0 and amount >= 0, in titled,
    non-empty sections. NaN is neither. An invoice left without sections is dropped.
    """

    def valid(a: Column) -> Column:
        positive = (a["quantite"] > 0) & ~F.isnan(a["quantite"]) & (a["montant"] >= 0) & ~F.isnan(a["montant"])
        return F.coalesce((a["libelle"] != "") & positive, F.lit(False))

    def section(s: Column) -> Column:
        trimmed = F.transform(s["articles"], lambda a: a.withField("libelle", browser_trim(a["libelle"])))
        return F.struct(browser_trim(s["titre"]).alias("titre"), F.filter(trimmed, valid).alias("articles"))

    kept = F.filter(
        F.transform("sections", section),
        lambda s: F.coalesce((s["titre"] != "") & (F.size(s["articles"]) > 0), F.lit(False)),
    )
    return compute_once(accepted, {"sections": kept}).where(F.size("sections") > 0)


def price(accepted: DataFrame) -> DataFrame:
    """Defaults for what is missing, and the net amount of every article.

    A net amount is rounded on its own, half to even.
    """

    def article(a: Column) -> Column:
        quantity = F.coalesce(a["quantite"], F.lit(DEFAULT_QUANTITY))
        amount = F.coalesce(a["montant"], F.lit(DEFAULT_AMOUNT))
        return F.struct(
            F.coalesce(a["libelle"], F.lit(DEFAULT_LABEL)).alias("libelle"),
            quantity.alias("quantite"),
            amount.alias("montant"),
            net_amount(amount, quantity, F.col("patient_percent")).alias("net"),
        )

    def section(s: Column) -> Column:
        articles = F.coalesce(F.transform(s["articles"], article), F.array())
        return F.struct(F.coalesce(s["titre"], F.lit(DEFAULT_TITLE)).alias("titre"), articles.alias("articles"))

    return accepted.withColumn("sections", F.transform("sections", section))


def net_amount(amount: Column, quantity: Column, patient_percent: Column) -> Column:
    return round_half_even(amount * quantity * patient_percent / 100)


def invoice_lines(priced: DataFrame, *keep: str) -> DataFrame:
    """One row per article of priced invoices, with its section and positions."""
    sections = priced.select(*keep, "patient_percent", F.posexplode("sections").alias("section_pos", "s"))
    return sections.select(
        *keep, "patient_percent", "section_pos", F.col("s.titre").alias("titre"),
        F.posexplode("s.articles").alias("article_pos", "a"),
    ).select(*keep, "patient_percent", "section_pos", "titre", "article_pos", "a.*")


def with_totals(priced: DataFrame) -> DataFrame:
    """Adds subtotals (titre, subtotal per section, in order) and total to priced invoices.

    An invoice is one row, so its sums need no shuffle. Sections are told apart by
    position; their titles may repeat.
    """

    def subtotal(s: Column) -> Column:
        net = F.aggregate(s["articles"], F.lit(0).cast("bigint"), lambda acc, a: acc + a["net"])
        return F.struct(s["titre"].alias("titre"), net.alias("subtotal"))

    return priced.withColumn("subtotals", F.transform("sections", subtotal)).withColumn(
        "total", F.aggregate("subtotals", F.lit(0).cast("bigint"), lambda acc, s: acc + s["subtotal"])
    )


def line_totals(lines: DataFrame, invoice: str, section: str, net: str = "net") -> DataFrame:
    """Subtotals and totals of a flat table of lines: (invoice, section, is_total, amount).

    The lines are read and summed once, to subtotals; only those are summed again.
    """
    subtotals = lines.groupBy(invoice, section).agg(F.sum(net).alias("_subtotal"))
    return subtotals.groupingSets(
        [[invoice, section], [invoice]], invoice, section
    ).agg(
        (F.grouping(section) == 1).alias("is_total"),
        F.sum("_subtotal").alias("amount"),
    )


def check_items(items: DataFrame, invoice: str, quantity: str, price: str) -> DataFrame:
    """(invoice, total, errors): the bill of each invoice, or what keeps it from being split.

    Every item must have a quantity and a price that read as whole numbers, and the total
    must fit a bigint; else the whole invoice is refused. Nothing is left out of a bill.
    Amounts are summed as decimals, per task before the shuffle.
    """
    q, p = F.col(quantity), F.col(price)
    missing = q.isNull() | p.isNull()
    whole = [spaced_int(c).cast("decimal(19,0)") for c in (q, p)]
    unreadable = ~missing & (whole[0].isNull() | whole[1].isNull())
    bills = items.groupBy(invoice).agg(
        F.try_sum(F.try_multiply(*whole)).alias("_amount"),
        F.bool_or(missing).alias("_missing"),
        F.bool_or(unreadable).alias("_unreadable"),
    )
    total = F.col("_amount").try_cast("bigint")
    readable = ~F.col("_missing") & ~F.col("_unreadable")
    errors = present([
        F.when(F.col("_missing"), F.lit("quantity and price are required")),
        F.when(F.col("_unreadable"), F.lit("quantity and price must be whole numbers")),
        F.when(readable & total.isNull(), F.lit("total is too large")),
    ])
    return bills.select(invoice, F.when(readable, total).alias("total"), errors.alias("errors"))


def coverage_split(checked: DataFrame, share: float = INSURER_SHARE) -> DataFrame:
    """(invoice, total, insurer, patient) of the accepted bills of `check_items`.

    The insurer pays its share truncated, the patient the rest.
    """
    insurer = (F.col("total") * F.lit(float(share))).cast("bigint")
    split = accepted_invoices(checked).withColumn("insurer", insurer)
    return split.withColumn("patient", F.col("total") - F.col("insurer"))
