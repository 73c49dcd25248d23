"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm import (
    conversation_repair,
    jaccard_join,
    license_scan,
    line_dedup,
    merkle_manifest,
    mixing,
    packing,
    pii,
    quality_rules,
    sharding,
    token_counts,
    topk_search,
    url_filters,
)
from linkgraph.llm.common import table
from linkgraph.llm.sql import ORACLES

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.quality_verdicts(table(spark, folder, "documents"))
    return found.select("doc_id", *BASE, "base_failed", "kept", F.array_join("failed_rates", ",").alias("failed_rates"))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.clean_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = sharding.shard(rows, ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.linked(docs).select("doc_id", "n_shingles", "component_id")


def op8_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = url_filters.judge_urls(pages, url_filters.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair_digests(table(spark, folder, "conversations"))


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.document_manifest(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_packing,
        op3_license_scan,
        op4_line_dedup,
        op5_sharding,
        op6_token_counts,
        op7_jaccard_join,
        op8_topk_search,
        op9_mixing,
        op10_url_filters,
        op11_conversation_repair,
        op12_pii,
        op13_merkle_manifest,
    )
}
__all__ = ["ORACLES", "QUERIES"]
