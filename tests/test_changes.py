from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import SF, plan
from pyspark.sql import functions as F

from visitbook.operators import changes, ingest
from visitbook.plans import stand_ins
from visitbook.plans.requests import intake
from visitbook.schemas import CHANGES, PATIENTS, WRITABLE

AT = dt.datetime(2024, 5, 1, 23, 30)
NEW = {"name": "Ana", "age_years": "1", "age_months": "6", "age_days": "10"}


def batch(spark, *rows):
    return spark.createDataFrame(rows, CHANGES).withColumn("received_at", F.lit(AT).cast("timestamp_ntz"))


def insert(seq, id, role="infirmiers", username="u_1", **fields):
    return (seq, "insert", id, role, username, {**NEW, **fields})


def update(seq, id, role="infirmiers", username="u_1", **fields):
    return (seq, "update", id, role, username, fields)


def delete(seq, id):
    return (seq, "delete", id, "infirmiers", "u_1", None)


def base(spark, *rows):
    full = [tuple({"id": i, **values}.get(n) for n in PATIENTS.names) for i, values in rows]
    return spark.createDataFrame(full, PATIENTS)


def check(spark, *rows):
    return {r.seq: r for r in ingest.check_inserts(batch(spark, *rows), F.col("received_at")).collect()}


def test_insert_errors(spark):
    got = check(
        spark,
        insert(1, 1),
        insert(2, 2, name=""),
        insert(3, 3, age_days="12.5"),
        insert(4, 4, poids="abc"),
        insert(5, 5, poids=""),
        insert(6, 6, shoe_size="42"),
        (7, "insert", 7, None, None, {**NEW, "id": "9"}),
        insert(8, 8, tension_arterielle="12/8", date_of_birth="31/12/1990"),
        (9, "insert", 9, None, None, {"name": "B"}),
        (10, "insert", 10, None, None, None),
        insert(11, 11, bilan="", phone_number=""),
    )
    errors = {seq: list(r.errors) for seq, r in got.items()}
    assert errors[1] == errors[5] == errors[11] == []
    assert errors[2] == ["name is required"]
    assert errors[3] == ["age_days must be an integer"]
    assert errors[4] == ["poids must be a number"]
    assert errors[6] == errors[7] == ["unknown column"]
    assert errors[8] == ["date_of_birth must be a date", "tension_arterielle must be a number"]
    assert errors[9] == [f"{p} must be an integer" for p in ("age_years", "age_months", "age_days")]
    assert errors[10][0] == "name is required"
    assert got[5].fields["poids"] is None
    assert got[11].fields["bilan"] == "" and got[11].fields["phone_number"] == ""


def test_insert_values(spark):
    rows = batch(
        spark,
        insert(1, 1, role="medecins", username="Dr_A_B", adresse="", poids=" 70.5 ", signature="forged"),
        insert(2, 2, age_months="", age_days="", created_at="1999-01-01", age="99"),
        insert(3, 3, role="medecins", username=None),
    )
    got = {r.name + str(i): r for i, r in enumerate(intake(rows, F.col("received_at"))["accepted"].collect())}
    a, b, c = got["Ana0"], got["Ana1"], got["Ana2"]
    assert (a.age, a.age_years, a.age_months, a.age_days) == (1.5273972603, 1, 6, 10)
    assert (a.adresse, a.poids, a.signature) == (None, 70.5, "Dr A B")
    assert a.created_at == dt.date(2024, 5, 2)  # half an hour before midnight UTC
    assert (b.age, b.age_months, b.created_at, b.signature) == (1.0, 0, dt.date(2024, 5, 2), None)
    assert c.signature == "medecins"


def applied(spark, table, *rows):
    out = changes.apply_changes(table, batch(spark, *rows), F.col("received_at"))
    return (
        {r.id: r for r in out.rows.collect()},
        {(r.id, r.seq): r for r in out.deleted.collect()},
        {r.seq: list(r.errors) for r in out.rejected.collect()},
    )


def test_update(spark):
    table = base(
        spark,
        (1, {"name": "Ana", "adresse": "x", "poids": 50.0, "phone_number": "7", "age": 3.0}),
        (2, {"name": "Bob", "adresse": "y"}),
    )
    rows, deleted, rejected = applied(
        spark, table,
        update(1, 1, name="Ana", adresse="", phone_number=""),
        update(2, 1, name="Ana", poids="61", age_years="9"),
        update(3, 99, name="Nobody"),
        update(4, 2, adresse="z"),
        update(5, 2, name="Bob", poids="heavy"),
        update(6, 2, name="Bob", shoe_size="1"),
        (7, "merge", 2, None, None, None),
        update(8, 2, name="Bob", role="medecins", username="Dr_C"),
    )
    assert sorted(rows) == [1, 2] and deleted == {}
    a = rows[1]
    assert (a.adresse, a.phone_number, a.poids, a.age, a.age_years) == (None, "", 61.0, 3.0, 9)
    assert (rows[2].adresse, rows[2].signature) == ("y", "Dr C")
    assert rejected == {
        4: ["name is required"], 5: ["poids must be a number"], 6: ["unknown column"], 7: ["unknown operation"]
    }


def test_order_of_changes(spark):
    table = base(spark, (1, {"name": "Ana", "adresse": "x"}), (2, {"name": "Bob"}))
    rows, deleted, rejected = applied(
        spark, table,
        insert(1, 10, adresse="a"), update(2, 10, name="Ana 2"), delete(3, 10),
        update(4, 1, name="Ana 3"), delete(5, 1), update(6, 1, name="late"), insert(7, 1, adresse="back"),
        update(8, 1, name="Ana 4"),
        insert(9, 2), delete(10, 77),
        insert(12, 11), insert(13, 11, adresse="again"), update(11, 11, name="too early"),
    )
    assert sorted(rows) == [1, 2, 11]
    assert (rows[1].name, rows[1].adresse) == ("Ana 4", "back")
    assert rows[2].name == "Bob" and rows[11].name == "Ana" and rows[11].adresse is None
    assert {k: v.name for k, v in deleted.items()} == {(10, 3): "Ana 2", (1, 5): "Ana 3"}
    assert deleted[(1, 5)].adresse == "x"
    assert rejected == {9: ["id exists"], 13: ["id exists"]}


def test_other_columns_are_kept(spark):
    table = base(spark, (1, {"name": "Ana"}), (2, {"name": "Bob"})).select("id", "name").withColumn("origin", F.lit("x"))
    rows, deleted, _ = applied(spark, table, update(1, 1, name="A"), delete(2, 2), insert(3, 3))
    assert {k: (r.name, r.origin) for k, r in rows.items()} == {1: ("A", "x"), 3: ("Ana", None)}
    assert deleted[(2, 2)].origin == "x"


def simulate(stored, rows):
    """One change after the other, on name and adresse."""
    table, images, refused = {i: dict(v) for i, v in stored.items()}, {}, set()
    for seq, op, id, _, _, fields in sorted(rows, key=lambda r: r[0]):
        if op == "delete":
            if id in table:
                images[(id, seq)] = table.pop(id)
        elif op == "insert":
            if id in table:
                refused.add(seq)
            else:
                table[id] = {"name": fields["name"], "adresse": fields.get("adresse") or None}
        elif id in table:
            table[id] |= {k: v or None for k, v in fields.items()}
    return table, images, refused


@pytest.fixture
def settings(spark):
    """Set Spark options for one test."""
    before = {}

    def put(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("seed,spread", [(1, 1), (2, 10**9), (3, 7)])
def test_changes_equal_one_by_one(spark, settings, seed, spread):
    """Random batches with one very busy id, whose changes span many stretches, dense or sparse."""
    settings(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="20")
    rng = random.Random(seed)
    stored = {i: {"name": f"n{i}", "adresse": "s"} for i in range(6)}
    rows = []
    for seq in [s * spread + rng.randrange(spread) for s in rng.sample(range(-200, 1000), 150)]:
        id = 1 if rng.random() < 0.4 else rng.randrange(9)
        fields = {"name": f"v{seq}"} | ({"adresse": rng.choice(["", f"a{seq}"])} if rng.random() < 0.5 else {})
        kind = rng.choice(["insert", "update", "update", "delete"])
        rows.append({"insert": insert, "update": update}[kind](seq, id, **fields) if kind != "delete" else delete(seq, id))
    got, deleted, rejected = applied(spark, base(spark, *stored.items()), *rows)
    table, images, refused = simulate(stored, rows)
    pair = lambda r: {"name": r.name, "adresse": r.adresse}
    assert {k: pair(v) for k, v in got.items()} == table
    assert {k: pair(v) for k, v in deleted.items()} == images
    assert set(rejected) == refused


def test_busy_id_is_no_single_window(spark, settings):
    """With sparse seq values one id's changes lie in several stretches, each a window of its own."""
    settings(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="8")
    rows = batch(spark, *[delete(i * 10**12, 1) for i in range(200)])
    stretches = changes.in_stretches(changes.check_changes(rows, F.col("received_at")))
    sizes = [r["count"] for r in stretches.groupBy("stretch").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 100
    lives = {r.seq: r.life for r in changes.number_lives(stretches).collect()}
    assert lives == {i * 10**12: i for i in range(200)}


def test_seq_must_be_unique(spark):
    table = base(spark, (1, {"name": "Ana"}), (2, {"name": "Bob"}))
    submitted = batch(
        spark, update(1, 1, name="A"), update(1, 2, name="B"), update(2, 2, name="C"), delete(4, 1), update(3, 1, name="")
    ).withColumn("seq", F.nullif("seq", F.lit(4)))
    out = changes.apply_changes(table, submitted, F.col("received_at"))
    assert {r.id: r.name for r in out.rows.collect()} == {1: "Ana", 2: "C"} and out.deleted.isEmpty()
    errors = sorted((r.seq or 0, list(r.errors)) for r in out.rejected.collect())
    assert errors == [(0, ["seq is required"]), (1, ["seq is not unique"]), (1, ["seq is not unique"]), (3, ["name is required"])]


def test_notifications(spark):
    rows = batch(
        spark, insert(1, 1), update(2, 1, name="A"), update(3, 1, name="B", temperature=""),
        update(4, 1, name="C", temperature="38"), delete(5, 1), update(6, 1, name="D", temperature=None),
        update(7, 1, name=""), insert(8, 2, name=""), insert(9, 3, poids="abc"), update(10, 1, temperature="38"),
    )
    checked = changes.check_changes(rows, F.col("received_at"))
    got = {r.seq: (r.recipient_group, r.patient_name) for r in changes.notifications(checked).collect()}
    assert got == {1: ("infirmiers", "Ana"), 2: ("medecins", "A"), 4: ("medecins", "C"), 6: ("medecins", "D")}


def test_audit_events(spark):
    at = F.lit(AT).cast("timestamp_ntz")
    table = base(spark, (1, {"name": "Ana", "poids": 50.0}))
    out = changes.apply_changes(table, batch(spark, delete(1, 1)), F.col("received_at"))
    event = changes.deletion_log(out.deleted, at, F.lit("infirmiers")).first()
    assert event.action == "Suppression d'un patient" and '"name":"Ana"' in event.details
    assert event.details.startswith("Le patient avec l'identifiant 1 a été supprimé. Voici les infos du patient supprimé {")
    assert '"poids":50.0' in event.details
    written = changes.change_log(batch(spark, insert(1, 1), update(2, 7, name="B"), delete(3, 1)), at).collect()
    assert [(r.action, r.details) for r in written] == [
        ("Ajout d'un patient", "Le patient 'Ana' a été ajouté"), ("modification patient", "Patient avec ID 7 a été modifié"),
    ]
    people = spark.createDataFrame([(7, "Ba", None)], "id long, nom string, prenom string")
    texts = [
        changes.event_log(people, kind, at, F.lit("infirmiers"), *map(F.col, names)).first()
        for kind, names in (("invoice", ["nom", "prenom"]), ("details", ["id"]), ("select", ["id"]))
    ]
    assert [(r.action, r.details) for r in texts] == [
        ("Facture généré", "Facture généré pour le patient Ba None"),
        ("Détails des patients", "Les détails du patient avec l'identifiant 7 ont été consulté."),
        ("Patient sélectionné", "Patient avec ID 7 selectionné."),
    ]


def test_updates_of_a_stored_table_do_not_shuffle_it(spark):
    """A small batch is broadcast to the stored table."""
    from conftest import plan

    events = stand_ins.table(spark, SF, "events")
    visits = stand_ins.table(spark, SF, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")
    )
    out = changes.apply_changes(visits, stand_ins.requests(events), F.col("received_at"))
    assert "SortMergeJoin" not in plan(out.rows)


def test_all_writable_columns_have_a_reader():
    assert set(WRITABLE) == set(PATIENTS.names) - {"id"}


def test_texts_are_read_before_the_stored_rows_are_met(spark):
    out = changes.apply_changes(base(spark, (1, {"name": "a"})), batch(spark, update(1, 1, name="b", poids="7")))
    met = [line for line in plan(out.rows, "simple").splitlines() if "Project [" in line and "first#" in line and "CASE" in line]
    assert met and not any("RLIKE" in line for line in met)
    assert [(r.name, r.poids) for r in out.rows.collect()] == [("b", 7.0)]


def test_lives_are_numbered_once(spark):
    out = changes.apply_changes(base(spark, (1, {"name": "a"})), batch(spark, insert(1, 1), insert(2, 2), insert(3, 2), delete(4, 2), insert(5, 2)))
    assert "Window" not in plan(out.rejected) + plan(out.rows)
    assert sorted((r.seq, list(r.errors)) for r in out.rejected.collect()) == [(1, ["id exists"]), (3, ["id exists"])]
