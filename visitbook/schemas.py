"""Table schemas and the fixed vocabularies of the data contract."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple[str, DataType] | tuple[str, DataType, bool]) -> StructType:
    return StructType([StructField(*f) for f in fields])


# One row per visit; a returning person is a new row with the same name.
PATIENTS = _struct(
    ("id", LongType(), False),
    ("name", StringType(), False),
    ("adresse", StringType()),
    ("age", DoubleType()),
    ("date_of_birth", DateType()),
    ("poids", DoubleType()),
    ("taille", DoubleType()),
    ("tension_arterielle", DoubleType()),
    ("temperature", DoubleType()),
    ("hypothese_de_diagnostique", StringType()),
    ("bilan", StringType()),
    ("resultat_bilan", StringType()),
    ("signature", StringType()),
    ("renseignements_clinique", StringType()),
    ("ordonnance", StringType()),
    ("created_at", DateType()),
    ("age_years", IntegerType()),
    ("age_months", IntegerType()),
    ("age_days", IntegerType()),
    ("phone_number", StringType()),
    ("meeting", StringType()),
    ("new_cases", StringType()),
    ("sexe", StringType()),
    ("groupe_sanguin", StringType()),
)

VISITS = _struct(
    ("id", LongType(), False),
    ("patient_id", LongType()),
    ("visit_date", DateType()),
    ("notes", StringType()),
)

ACTION_LOGS = _struct(
    ("id", LongType(), False),
    ("timestamp", TimestampType(), False),
    ("user_type", StringType()),
    ("action", StringType(), False),
    ("details", StringType()),
)

# A change names only the columns it supplies: a key that is absent leaves the
# column alone, a key whose value is null clears it.
CHANGES = _struct(
    ("seq", LongType(), False),
    ("op", StringType(), False),
    ("id", LongType(), False),
    ("role", StringType()),
    ("username", StringType()),
    ("fields", MapType(StringType(), StringType())),
)

# Amounts arrive as JSON numbers or as text, so they are read as text and
# converted by the invoice operators, which can then report what is not a number.
ARTICLE = _struct(("libelle", StringType()), ("quantite", StringType()), ("montant", StringType()))
SECTION = _struct(("titre", StringType()), ("articles", ArrayType(ARTICLE)))
INVOICE_META = _struct(
    ("nom", StringType()),
    ("prenom", StringType()),
    ("police", StringType()),
    ("assurance", StringType()),
    ("pourcentage", StringType()),
    ("envoye_a", StringType()),
)
INVOICE = _struct(
    ("invoice_id", LongType()),
    ("meta", INVOICE_META),
    ("sections", ArrayType(SECTION)),
)

# Columns a change may write. The key and anything unknown are refused.
WRITABLE = {f.name: f.dataType for f in PATIENTS if f.name != "id"}

# ---------------------------------------------------------------------------
# Role names, visible columns, French labels, blank-to-null lists,
# fees and shares. They are part of the data contract and must not be changed.
# ---------------------------------------------------------------------------
PHYSICIANS = "medecins"
NURSES = "infirmiers"
RECEPTIONISTS = "receptionistes"

ROLE_COLUMNS = {
    PHYSICIANS: [
        "created_at", "name", "adresse", "phone_number", "meeting", "new_cases", "age", "poids",
        "taille", "tension_arterielle", "temperature", "hypothese_de_diagnostique",
        "renseignements_clinique", "bilan", "resultat_bilan", "ordonnance", "signature",
    ],
    NURSES: ["created_at", "name", "poids", "taille", "tension_arterielle", "temperature"],
    RECEPTIONISTS: [
        "created_at", "name", "adresse", "phone_number", "meeting", "new_cases", "age",
    ],
}

LABELS = {
    "created_at": "Date de création",
    "name": "Nom",
    "adresse": "Adresse",
    "age": "Age",
    "poids": "Poids",
    "taille": "Taille",
    "tension_arterielle": "Tension",
    "temperature": "Température",
    "hypothese_de_diagnostique": "Hypothèse de diagnostique",
    "renseignements_clinique": "Renseignement clinique",
    "bilan": "Bilan",
    "resultat_bilan": "Conclusion du bilan",
    "ordonnance": "Ordonnance",
    "signature": "Signature",
    "meeting": "Rendez-vous",
    "new_cases": "Nouveaux cas",
    "phone_number": "Numero de telephone",
}

UNITS = {"poids": "kg", "taille": "cm", "tension_arterielle": "mmHg", "temperature": "°C"}

INSERT_BLANK_TO_NULL = ["name", "adresse", "date_of_birth", "tension_arterielle"]
INSERT_NUMERIC = ["age", "poids", "taille", "temperature", "age_years", "age_months", "age_days"]
AGE_PARTS = ["age_years", "age_months", "age_days"]
UPDATE_BLANK_TO_NULL = [
    "name", "adresse", "age", "date_of_birth", "poids", "taille", "tension_arterielle",
    "temperature", "hypothese_de_diagnostique", "bilan", "resultat_bilan", "signature",
    "renseignements_clinique", "ordonnance", "created_at", "age_months", "age_days", "age_years",
]

VISIT_FEE = 10_000
INSURER_SHARE = 0.80
PAGE_SIZE = 20
CLINIC_TIME_ZONE = "+01:00"
