"""The queries of the package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, conversations, dartminhash, licenses, lines, mixing, pii, suffixes, tiling, tokens, topk, toxicity, urls
from .common import scratch, table
from .sql import SQL

#: Fixed rules of the URL filter.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    # a cache of its own for each call, so a run never rests on an earlier one
    cache = scratch(spark, "token-cache")
    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


def op2_bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return topk.search(docs, docs.filter("doc_id % 50 = 0"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("spans")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge_urls(table(spark, folder, "pages"), rules)


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", "source")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.describe(pii.find_personal_data(table(spark, folder, "documents")))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damaged(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bm25_search": op2_bm25_search,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_source_mix": op10_source_mix,
    "op11_filter_audit": op11_filter_audit,
    "op12_personal_data": op12_personal_data,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {name: SQL[name] for name in QUERIES if name in SQL}
