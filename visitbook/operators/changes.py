"""Applying a batch of inserts, updates and deletes, in the order of `seq`.

Changes without a `seq`, or that share one, are refused. The outcome equals running the
others one by one: an update of an unknown id does nothing, an insert of an existing id is
refused, and a deleted id may be inserted again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitbook.columns import compute_once
from visitbook.operators.ingest import accepted, insert_columns, rejected, typed, update_columns
from visitbook.schemas import CLINIC_TIME_ZONE, NURSES, PHYSICIANS, WRITABLE
from visitbook.session import settle

# Action names and event texts of the audit log.
ACTIONS = {
    "insert": "Ajout d'un patient",
    "update": "modification patient",
    "delete": "Suppression d'un patient",
    "invoice": "Facture généré",
    "details": "Détails des patients",
    "select": "Patient sélectionné",
}
EVENT_TEXTS = {
    "insert": "Le patient '%s' a été ajouté",
    "update": "Patient avec ID %s a été modifié",
    "delete": "Le patient avec l'identifiant %s a été supprimé. Voici les infos du patient supprimé %s",
    "invoice": "Facture généré pour le patient %s %s",
    "details": "Les détails du patient avec l'identifiant %s ont été consulté.",
    "select": "Patient avec ID %s selectionné.",
}


class Applied(NamedTuple):
    rows: DataFrame      # the table after the batch
    deleted: DataFrame   # each deleted row as it was, with the seq of its deletion
    rejected: DataFrame  # refused changes with their errors


def check_changes(
    changes: DataFrame, received_at: Column | None = None, tz: str = CLINIC_TIME_ZONE
) -> DataFrame:
    """Cleaned fields and errors for every change, by its kind, in one pass.

    `ready` tells whether an update leaves the temperature filled in, as it was submitted:
    a blank is not, and not mentioning it is. The cleaned fields no longer show that.
    """
    new_fields, new_errors = insert_columns(received_at, tz)
    set_fields, set_errors = update_columns()
    new = F.struct(new_fields.alias("fields"), new_errors.alias("errors"))
    changed = F.struct(set_fields.alias("fields"), set_errors.alias("errors"))
    checked = _by_kind(changes, new, changed)
    fields = F.coalesce("_insert.fields", "_update.fields")
    return checked.withColumns({"fields": fields, "errors": _errors("_insert.errors", "_update.errors")}).drop("_insert", "_update")


def judge_changes(changes: DataFrame) -> DataFrame:
    """`errors` and `ready` as `check_changes` gives them, beside the fields as submitted.

    For who only needs to know which changes are accepted: no cleaned fields are built.
    """
    judged = _by_kind(changes, insert_columns()[1], update_columns()[1])
    return judged.withColumn("errors", _errors("_insert", "_update")).drop("_insert", "_update")


def _by_kind(changes: DataFrame, of_insert: Column, of_update: Column) -> DataFrame:
    """Adds `_insert` and `_update`, each for its kind, and `ready`, evaluated once per change."""
    op = F.col("op")
    ready = F.coalesce(F.col("fields")["temperature"], F.lit("-")) != ""
    # One kind after the other: both in one step make code too long to be compiled.
    first = compute_once(changes, {"_insert": F.when(op == "insert", of_insert), "ready": ready})
    return compute_once(first, {"_update": F.when(op == "update", of_update)})


def _errors(of_insert: str, of_update: str) -> Column:
    op = F.col("op")
    return (
        F.when(op.isin("insert", "update"), F.coalesce(of_insert, of_update))
        .when(op == "delete", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("unknown operation")))
    )


def in_stretches(changes: DataFrame) -> DataFrame:
    """The changes with `stretch`, to be written out before they are used several times.

    Stretches are the partitions of a range partitioning by id and seq, so they follow each
    other in the order of the changes of an id, whatever values seq has, and an id with very
    many changes spans many of them.
    """
    return changes.repartitionByRange("id", "seq").withColumn("stretch", F.spark_partition_id())


def prepare_changes(
    changes: DataFrame, received_at: Column | None = None, tz: str = CLINIC_TIME_ZONE
) -> DataFrame:
    """The changes in stretches, cleaned and checked, written to the shared folder.

    The ranges are found from the changes as submitted, so each is checked once.
    """
    return settle(check_changes(in_stretches(changes), received_at, tz), changes.sparkSession, "checked")


def number_lives(changes: DataFrame) -> DataFrame:
    """Adds `life`: how many deletions of the same id come before a change; see `in_stretches`.

    A running count in two levels, so that an id with very many changes is never one
    window: deletions are summed per stretch, the few sums are accumulated per id, and
    within a stretch the changes are counted in order.
    """
    is_delete = F.when(F.col("op") == "delete", 1).otherwise(0)
    marked = changes.withColumn("_delete", is_delete)
    before = Window.partitionBy("id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        marked.groupBy("id", "stretch")
        .agg(F.sum("_delete").alias("_n"))
        .select("id", "stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
        .where(F.col("_earlier") > 0)
    )
    within = Window.partitionBy("id", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.join(earlier, ["id", "stretch"], "left")
        .withColumn(
            "life",
            F.coalesce("_earlier", F.lit(0)) + F.coalesce(F.sum("_delete").over(within), F.lit(0)),
        )
        .drop("_delete", "_earlier")
    )


def check_order(checked: DataFrame) -> DataFrame:
    """Adds an error to changes that have no seq or share it with another.

    The shared ones are counted apart and written out; few as they are, Spark sends them to
    the changes instead of shuffling these.
    """
    shared = checked.groupBy("seq").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1 OR seq IS NULL")
    shared = settle(shared, checked.sparkSession, "shared")
    marked = checked.alias("c").join(shared.alias("s"), F.expr("c.seq <=> s.seq"), "left")
    problem = F.when(
        F.col("_times").isNotNull(), F.when(F.col("c.seq").isNull(), "seq is required").otherwise("seq is not unique")
    )
    none = F.array().cast("array<string>")
    errors = F.concat("errors", F.when(problem.isNotNull(), F.array(problem)).otherwise(none))
    return marked.select(*[errors.alias(c) if c == "errors" else F.col(f"c.{c}") for c in checked.columns])


def fold_changes(changes: DataFrame) -> DataFrame:
    """One row per (id, life): when it starts and ends, and what it sets.

    start      seq of the insert that begins it, null if only a stored row can
    ended      seq of the deletion that ends it, null if it survives the batch
    n_inserts  number of inserts, of which all but the first are refused
    born       fields of the first insert
    set        per column the latest update that names it: struct(seq, value)

    Every output is a maximum or minimum, so a hot id is reduced before the shuffle.
    """
    return _fold_lives(number_lives(changes))


def _fold_lives(numbered: DataFrame) -> DataFrame:
    fields = F.col("fields")
    inserted = F.col("op") == "insert"
    latest = [
        F.max(
            F.when((F.col("op") == "update") & F.map_contains_key(fields, c), F.struct("seq", fields[c].alias("value")))
        ).alias(c)
        for c in WRITABLE
    ]
    return (
        numbered.groupBy("id", "life")
        .agg(
            F.min(F.when(inserted, F.col("seq"))).alias("start"),
            F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("ended"),
            F.count_if(inserted).alias("n_inserts"),
            F.min_by(F.when(inserted, fields), F.when(inserted, F.col("seq"))).alias("born"),
            *latest,
        )
        .select("id", "life", "start", "ended", "n_inserts", "born", F.struct(*WRITABLE).alias("set"))
    )


def apply_changes(
    base: DataFrame, changes: DataFrame, received_at: Column | None = None, tz: str = CLINIC_TIME_ZONE
) -> Applied:
    """Apply a batch of changes to the stored table.

    The folded batch is written once to the shared scratch folder: the results use it
    several times, and the size of the written table lets Spark join the stored table
    without shuffling it when the batch is small. Columns that changes cannot write are
    kept for stored rows and are null in new ones.
    """
    return apply_checked(base, check_order(prepare_changes(changes, received_at, tz)))


def apply_checked(base: DataFrame, checked: DataFrame) -> Applied:
    """Apply changes that have been checked and put in stretches: `prepare_changes`, `check_order`.

    Lives are numbered once and written out. Texts are read as the columns' types on the folded
    batch, not beside the stored rows, most of which no change names.
    """
    spark = base.sparkSession
    numbered = settle(number_lives(accepted(checked)), spark, "numbered")
    update = lambda c: F.col(f"set.{c}")
    read = [F.when(update(c).isNotNull(), F.struct(typed(update(c)["value"], c).alias("value"))).alias(c) for c in WRITABLE]
    lives_folded = _fold_lives(numbered).withColumn("first", F.when(F.col("life") == 0, F.struct(*read)))
    folded = settle(lives_folded, spark, "folded")
    others = [c for c in base.columns if c != "id"]

    def changed(c: str) -> Column:
        return F.when(F.col(f"first.{c}").isNull(), F.col(c)).otherwise(F.col(f"first.{c}.value")).alias(c)

    def begins(c: str) -> Column:
        submitted = F.when(update(c)["seq"] > F.col("start"), update(c)["value"]).otherwise(F.col("born")[c])
        return typed(submitted, c).alias(c)

    # Stored rows with the changes of their first life.
    first = folded.where(F.col("life") == 0).select("id", "ended", "first")
    stored = base.join(first, "id", "left").select(
        "id", F.col("ended"), *[changed(c) if c in WRITABLE else F.col(c) for c in others]
    )
    # Lives that begin with an insert; a first life cannot if the id is stored already.
    begun = folded.where(F.col("start").isNotNull())
    taken = base.select("id").join(begun.where(F.col("life") == 0).select("id"), "id", "left_semi")
    taken = taken.withColumn("life", F.lit(0).cast(folded.schema["life"].dataType))
    fresh = begun.join(taken, ["id", "life"], "left_anti").select(
        "id", "ended", *[begins(c) for c in others if c in WRITABLE]
    )
    lives = stored.unionByName(fresh, allowMissingColumns=True)

    # Inserts that met an existing row.
    inserts = numbered.where(F.col("op") == "insert")
    clash = (
        inserts.join(begun.select("id", "life", "start"), ["id", "life"])
        .join(taken.withColumn("_stored", F.lit(True)), ["id", "life"], "left")
        .where(F.col("_stored").isNotNull() | (F.col("seq") != F.col("start")))
        .withColumn("errors", F.array(F.lit("id exists")))
    )
    return Applied(
        rows=lives.where(F.col("ended").isNull()).drop("ended"),
        deleted=lives.where(F.col("ended").isNotNull()).withColumnRenamed("ended", "seq"),
        rejected=rejected(checked).unionByName(clash.select(*checked.columns)),
    )


def deletion_log(deleted: DataFrame, at: Column, role: Column) -> DataFrame:
    """Audit events that name each deleted row and keep it as JSON: timestamp, user_type, action, details."""
    image = F.to_json(F.struct(*[c for c in deleted.columns if c != "seq"]))
    details = F.format_string(EVENT_TEXTS["delete"], F.col("id").cast("string"), image)
    return deleted.select(
        at.alias("timestamp"), role.alias("user_type"), F.lit(ACTIONS["delete"]).alias("action"), details.alias("details")
    )


def change_log(accepted_changes: DataFrame, at: Column) -> DataFrame:
    """Audit events of accepted inserts and updates."""
    written = accepted_changes.where(F.col("op").isin("insert", "update"))
    is_insert = F.col("op") == "insert"
    subject = F.when(is_insert, F.col("fields")["name"]).otherwise(F.col("id").cast("string"))
    text = F.when(is_insert, F.lit(EVENT_TEXTS["insert"])).otherwise(F.lit(EVENT_TEXTS["update"]))
    action = F.when(is_insert, F.lit(ACTIONS["insert"])).otherwise(F.lit(ACTIONS["update"]))
    return written.select(
        at.alias("timestamp"), F.col("role").alias("user_type"), action.alias("action"),
        F.replace(text, F.lit("%s"), subject).alias("details"),
    )


def event_log(rows: DataFrame, kind: str, at: Column, role: Column, *subjects: Column) -> DataFrame:
    """Audit events of another kind: `invoice` for priced invoices (last and first name of the
    patient), `details` and `select` for opened records (their id). A null subject reads None.
    """
    shown = [F.coalesce(s.cast("string"), F.lit("None")) for s in subjects]
    details = F.format_string(EVENT_TEXTS[kind], *shown)
    return rows.select(
        at.alias("timestamp"), role.alias("user_type"), F.lit(ACTIONS[kind]).alias("action"), details.alias("details")
    )


def notifications(checked: DataFrame) -> DataFrame:
    """Who must be told of accepted changes: (seq, recipient_group, patient_name, reason).

    Takes the result of `judge_changes` or `check_changes`; refused changes are announced to nobody. A new visit
    goes to the nurses. An update goes to the physicians unless it leaves the temperature
    blank; not mentioning the temperature counts as filled in. Row by row, so it also runs
    on a stream; that an id is taken or a seq repeated only shows when a batch is applied.
    """
    fields = F.col("fields")
    new = (F.col("op") == "insert") & fields["name"].isNotNull()
    ready = (F.col("op") == "update") & F.col("ready")
    return accepted(checked).where(new | ready).select(
        "seq",
        F.when(F.col("op") == "insert", F.lit(NURSES)).otherwise(F.lit(PHYSICIANS)).alias("recipient_group"),
        fields["name"].alias("patient_name"),
        F.when(F.col("op") == "insert", F.lit("new visit")).otherwise(F.lit("visit updated")).alias("reason"),
    )
