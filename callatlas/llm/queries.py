"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from ._common import table
from .audit import audit_filters
from .chat import format_chats
from .decontamination import find_contamination
from .infill import form_texts, restore_texts
from .licenses import PHRASES, default_templates, scan_licenses
from .mixing import mix
from .ngrams import score_documents
from .pii import BASE_KINDS, find_pii, train_pii
from .quality import score_quality, train_quality
from .secrets import KINDS, count_kind, scan_secrets, spans_text, trained_on
from .simhash import near_duplicates
from .sketches import edited_sketches, text_of
from .urls import judge_urls, page_labels


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train_pii(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS]
    plain = F.concat("base", F.transform("extra", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(plain).alias("spans"), F.size("extra").cast("bigint").alias("n_extra"), (F.size("base") + F.size("extra")).cast("bigint").alias("n_spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, page_labels(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, trained_on(docs))
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    counts = [count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op7_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_sketches(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "contained")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle texts of all documents and what comes back from them; edge cases as form_texts states."""
    found = restore_texts(form_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each order, by language; edge cases as audit_filters states."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents; edge cases as scan_licenses states."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_url_rules": op3_url_rules,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_interpolation": op7_interpolation,
    "op8_sketches": op8_sketches,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
    "op11_infill": op11_infill,
    "op12_audit": op12_audit,
    "op13_licenses": op13_licenses,
}
ORACLE_SQL = {"op3_url_rules": sql.OP3, "op4_mixing": sql.OP4, "op10_decontamination": sql.OP10, "op11_infill": sql.OP11, "op12_audit": sql.OP12, "op13_licenses": sql.op13(default_templates(), PHRASES)}
