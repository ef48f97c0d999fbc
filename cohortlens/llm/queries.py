"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontamination, importance, near_duplicates, packing, page_text, quality, rare_features, repeated_passages, sharding, token_alignment, token_counts, token_files, toxicity
from cohortlens.llm.common import read


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def token_count_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.cached_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), sharding.even_tree(24), sharding.even_tree(25))


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_ids(spark, path)


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_components(read(spark, sf_dir, "documents"))


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = toxicity_model(spark, sf_dir)
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    labels = read(spark, sf_dir, "labels").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    return toxicity.fit(read(spark, sf_dir, "documents"), labels)


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_main_text(read(spark, sf_dir, "pages"))


def rare_feature_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return rare_features.edit_likeness(docs, rare_features.rarity(docs))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": best_fit_packing,
        "op2_token_counts": token_count_cache,
        "op3_decontamination": benchmark_decontamination,
        "op4_quality_rules": line_quality,
        "op5_sharding": hash_tree_sharding,
        "op6_token_ids": token_id_files,
        "op7_simhash_near_dedup": simhash_near_dedup,
        "op8_toxicity": toxic_documents,
        "op9_suffix_array_dedup": suffix_array_dedup,
        "op10_html_extraction": main_text,
        "op11_document_fingerprints": rare_feature_fingerprints,
        "op12_importance_resampling": importance_resampling,
        "op13_cross_tokenizer_alignment": cross_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {}
