from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF, plan
from pyspark.sql import functions as F

from visitbook.operators import access, history, search
from visitbook.plans import stand_ins
from visitbook.plans.requests import conform, listing
from visitbook.schemas import LABELS, PATIENTS, ROLE_COLUMNS

D = dt.date


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Ana Diallo", None, D(2024, 1, 1)),
        (2, "Bob", "Rue Ana 5", D(2024, 3, 1)),
        (3, "ana diallo", "X_Y", None),
        (4, "Ana Diallo", "XZY", D(2024, 3, 1)),
        (5, "Old", None, D(1960, 1, 1)),
    ]
    return spark.createDataFrame(rows, "id long, name string, adresse string, created_at date").cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search(people):
    assert ids(search.search(people, "ana")) == [1, 2, 3, 4]
    assert ids(search.search(people, "")) == [1, 2, 3, 4, 5]
    assert ids(search.search(people, "X_Y")) == [3, 4]
    assert ids(search.search(people, r"X\_Y")) == [3]
    assert ids(search.search(people, "A%o")) == [1, 3, 4]
    assert ids(search.search(people, r"\Bob")) == [2]


def test_search_many_equals_single_searches(people):
    queries = ["ana", "X_Y", "zzz", ""]
    many = search.search_many(people, queries)
    for q in queries:
        assert ids(many.where(F.col("q") == q)) == ids(search.search(people, q))
    assert "Join" not in plan(many)


def test_latest(people):
    assert [r.id for r in search.latest(people, 10).collect()] == [2, 4, 1, 3, 5]
    assert [r.id for r in search.latest(people, 2).collect()] == [2, 4]
    assert "TakeOrderedAndProject" in plan(search.latest(people, 2))


@pytest.mark.parametrize("given,size", [(0, 20), (-3, 20), ("x", 20), ("", 20), (None, 20), ("7", 7), (5, 5), ("12px", 12)])
def test_page_size(given, size):
    assert search.page_size(given) == size


def test_by_id(spark, people):
    assert ids(search.by_id(people, 3)) == [3] and ids(search.by_id(people, 99)) == []
    wanted = spark.createDataFrame([(1,), (1,), (4,), (77,)], "id long")
    assert ids(search.by_ids(people, wanted)) == [1, 4]


def test_history(spark, people):
    assert ids(history.history_of(people, 1)) == [1, 4]
    assert ids(history.history_of(people, 3)) == [3]
    assert ids(history.history_of(people, 99)) == []
    wanted = spark.createDataFrame([(1,), (4,), (3,)], "id long")
    found = history.visit_history(people, wanted)
    assert ids(found) == [1, 3, 4]
    assert {r.id: r.n_visits for r in found.collect()} == {1: 2, 4: 2, 3: 1}


def test_history_equals_brute_force(spark):
    visits = stand_ins.visits(spark, SF)
    rows = visits.select("id", "name").collect()
    wanted = {r.user_id for r in stand_ins.table(spark, SF, "events").select("user_id").collect()}
    names = {r.name for r in rows if r.id in wanted}
    viewed = stand_ins.table(spark, SF, "events").select(F.col("user_id").alias("id"))
    assert ids(history.visit_history(visits, viewed)) == sorted(r.id for r in rows if r.name in names)


def test_visits_of_a_hot_name_are_split(spark):
    """Most visits carry one name; without a broadcast they still go to several tasks."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    name = F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string"))
    visits = spark.range(0, 20000, 1, 8).select("id", name.alias("name"), F.sha2(F.col("id").cast("string"), 512).alias("notes"))
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        df = history.visit_history(visits, spark.createDataFrame([(1,), (1,), (8,)], "id long"))
        rows = df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(rows) == 16001 and {(r.name, r.n_visits) for r in rows} == {("hot", 16000), ("8", 1)}


def test_history_of_a_very_frequent_name(spark):
    """Half of the rows share one name, and that name is asked for many times."""
    visits = spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 7)).alias("name")
    )
    wanted = spark.range(0, 4000, 2).unionByName(spark.createDataFrame([(1,)], "id long"))
    found = history.visit_history(visits, wanted)
    got = {r.name: (r.n, r.least, r.most) for r in found.groupBy("name").agg(
        F.count("*").alias("n"), F.min("n_visits").alias("least"), F.max("n_visits").alias("most")).collect()}
    one = sum(1 for i in range(1, 4000, 2) if i % 7 == 1)
    assert got == {"hot": (2000, 2000, 2000), "n1": (one, one, one)}


def test_roles():
    assert {role: len(columns) for role, columns in ROLE_COLUMNS.items()} == {
        "medecins": 17, "infirmiers": 6, "receptionistes": 7
    }
    assert all(len(set(c)) == len(c) for c in ROLE_COLUMNS.values())
    assert all(c in LABELS and c in PATIENTS.names for cols in ROLE_COLUMNS.values() for c in cols)


def test_project_for_role(people):
    full = conform(people)
    assert access.project_for_role(full, "nobody").columns == []
    assert access.project_for_role(full, "infirmiers").columns == ROLE_COLUMNS["infirmiers"]
    labelled = access.display_labels(full.select("name", "poids", "id"))
    assert labelled.columns == ["Nom", "Poids", "id"]


def test_can_edit(spark):
    rows = [(None,), ("",), ("Dr A B",), ("Dr C",)]
    df = spark.createDataFrame(rows, "signature string")

    def allowed(role, user):
        out = access.editable_by(df, F.lit(role), F.lit(user), "Dr_Lead").collect()
        return {r.signature: r.can_edit for r in out}

    assert allowed("medecins", "Dr_A_B") == {None: True, "": False, "Dr A B": True, "Dr C": False}
    assert set(allowed("infirmiers", "x").values()) == {True}
    assert set(allowed("receptionistes", "x").values()) == {True}
    assert set(allowed("medecins", "Dr_Lead").values()) == {True}
    assert allowed("other", "") == {None: True, "": False, "Dr A B": False, "Dr C": False}


def test_listing(spark):
    row = {f.name: None for f in PATIENTS} | {
        "id": 1, "name": "N" * 31, "age": 1.5, "age_years": 1, "age_months": 6, "age_days": 0,
        "poids": 70.0, "temperature": 38.5, "created_at": D(2024, 1, 2),
    }
    df = spark.createDataFrame([tuple(row[n] for n in PATIENTS.names)], PATIENTS)
    shown = listing(df, "", "medecins").first().asDict()
    assert list(shown) == [LABELS[c] for c in ROLE_COLUMNS["medecins"]]
    assert shown["Nom"] == "N" * 30 + "..." and shown["Age"] == "1 ans 6 mois"
    assert shown["Poids"] == "70 kg" and shown["Température"] == "38.5 °C" and shown["Taille"] == ""
    assert shown["Date de création"] == "2024-01-02 00:00:00"


def test_listing_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "patients")
    spark.createDataFrame([], PATIENTS).write.parquet(path)
    text = plan(listing(spark.read.schema(PATIENTS).parquet(path), "a", "infirmiers"))
    read = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "ordonnance" not in read and "poids" in read
    assert "TakeOrderedAndProject" in text
