"""One query per operator over its whole table, in the result form its contract fixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.decontaminate import decontaminate
from geoloom.llm.fingerprint import fingerprints
from geoloom.llm.mixing import mix_sources
from geoloom.llm.ngram_join import jaccard_components
from geoloom.llm.pii import sanitise
from geoloom.llm.quality import resample
from geoloom.llm.secrets import scan_secrets
from geoloom.llm.sharding import assign_shards
from geoloom.llm.substring_dedup import dedup_substrings
from geoloom.llm.token_output import training_order


#: A public byte-level BPE with 50,256 ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(_table(spark, sf_dir, "documents"), count_links=True)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "n_links")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contain_edited", "contain_next")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "bytes", "shard", "depth", "shard_bytes")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(_table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


def op8_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_term", F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, _table(spark, sf_dir, "labels")).drop("text")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_secret_scan": op5_secret_scan,
        "op6_sharding": op6_sharding,
        "op7_token_output": op7_token_output,
        "op8_pii_sanitisation": op8_pii_sanitisation,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_mix_sources": op10_mix_sources,
    }
