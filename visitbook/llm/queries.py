"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitbook.llm import (
    conversation_repair,
    decontamination,
    html_extraction,
    jaccard_join,
    language_id,
    license_scan,
    lm_scoring,
    merkle_manifest,
    neighbours,
    packing,
    secret_scan,
    suffix_dedup,
    url_filter,
)
from visitbook.llm.ordered_rows import group_key
from visitbook.llm.sql import ORACLE  # noqa: F401 - registered with the queries
from visitbook.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return str(public_tokenizers.path(TOKENIZER))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op1_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # One evaluation of the spans' texts per document; they are listed by start and kind.
    of_kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", of_kind("assign").alias("n_assign"), of_kind("access").alias("n_access"), of_kind("hex").alias("n_hex"),
        hex_sha256(listed(base)).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


@query
def op5_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]).cast("bigint"))
    return found.select(
        "doc_id", "n_words", length.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op6_packing(spark, sf_dir):
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(spark, table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = language_id.fold(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_url_filter(spark, sf_dir):
    found = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op7_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(spark, table(spark, sf_dir, "documents"))


@query
def op2_neighbours(spark, sf_dir):
    return neighbours.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op8_lm_scoring(spark, sf_dir):
    held_out = language_id.fold(F.col("doc_id"), 5) == 1
    scored = lm_scoring.score_documents(spark, table(spark, sf_dir, "documents"), held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents")).drop("text")


@query
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = lambda text: merkle_manifest.leaf_digest(*map(F.col, fields), text)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(lowered))
    manifest = merkle_manifest.build_manifest(
        spark, docs, F.col("source"), F.col("doc_id"), leaf(F.col("text")), {"doc_id": F.col("doc_id"), "tampered": tampered}
    )
    folded = merkle_manifest.folded_root(F.coalesce("tampered", "digest"), F.col("path"))
    return merkle_manifest.proofs(manifest).select(
        "doc_id", F.col("digest").alias("leaf"), F.col("tree_root").alias("subroot"), "root",
        merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows, some of them dropped, emptied, cut, repeated or relabelled by a hash of their place."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text, k = shown("text"), F.col("kind")
    changed = conversations.select("conv_id", "turn", shown("role").alias("role"), text.alias("text"), kind.alias("kind")).where(k != 0)
    return changed.select(
        "conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@query
def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, judged = conversation_repair.repair_conversations(spark, damaged(rows))
    found = judged.join(conversation_repair.repaired_digests(turns, judged), "conv", "left")
    every = rows.select(group_key(F.col("conv_id")).alias("conv")).distinct().join(found, "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select(
        conversation_repair.conversation_of(F.col("conv"), rows).alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", hex_sha256(F.lit(""))).alias("repaired_sha256"),
    )


@query
def op11_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extraction.extract(spark, pages, "page_id", "url")
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
