"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.llm import decontamination, jaccard_join, language_id, packing, secret_scan
from visitbook.llm.queries import table, tokenizer_path
from visitbook.session import configure, settle


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise. Null texts, texts without a letter and
    texts far above their language's calibrated cross-entropy go. Where no document is
    labelled there is nothing to reject by but the text itself: those with letters stay.
    """
    configure(spark)
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = language_id.identify(docs, model)
    return judged.where("NOT rejected").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return jaccard_join.deduplicate(configure(spark), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that has no other words goes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; the documents stay."""
    configure(spark)
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining texts as token pieces packed into sequences."""
    return packing.pack_documents(configure(spark), docs, tokenizer_path())


STAGES = [
    ("language_id", identified),
    ("jaccard_join", distinct),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("packing", packed),
]

# The stages train models, tokenise and pack, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), spark, f"stage-{name}")
    return docs
