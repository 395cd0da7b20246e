"""The operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheeltrace.llm import (
    exact_dedup,
    filter_audit,
    imatch,
    minhash,
    mixing,
    packing,
    pii,
    prefix_trie,
    quality_model,
    quality_rules,
    sharding,
    suffix_dedup,
    url_filter,
)
from wheeltrace.llm.common import table, tokenizer_path


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_model.score_quality(docs, labels)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "source", "size", "block", "release", "due", "slot")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    stats = quality_rules.measured(docs).drop("text")
    return quality_rules.judged(stats).select(
        "doc_id", "quality.*", "base_failed", "host_rejected", "kept"
    )


def op4_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_path()).drop("closed_by")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.listed_by_label(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs).select("doc_id", "pii.*")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(table(spark, sf_dir, "documents"))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )
    return sharding.shard(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit(docs, labels)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), all_hashes=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_gam": op1_quality_gam,
        "op2_mix_sources": op2_mix_sources,
        "op3_quality_rules": op3_quality_rules,
        "op4_pack_windows": op4_pack_windows,
        "op5_url_filter": op5_url_filter,
        "op6_pii_spans": op6_pii_spans,
        "op7_suffix_array": op7_suffix_array,
        "op8_imatch": op8_imatch,
        "op9_histogram_shards": op9_histogram_shards,
        "op10_minhash_tensored": op10_minhash_tensored,
        "op11_filter_audit": op11_filter_audit,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_exact_dedup": op13_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
        "op13_exact_dedup": exact_dedup.ORACLE_SQL,
    }
