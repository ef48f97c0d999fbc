"""The corpus pipeline: toxic documents, near copies, repeated passages and benchmark leaks go; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontamination, near_duplicates, packing, repeated_passages, toxicity
from cohortlens.llm.common import read, stored
from cohortlens.llm.queries import toxicity_model


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go.

    A null or empty text has no words and stays unless such texts are rejected; repeated rows are each judged; no rows give no rows. Ids, labels and other columns aren't looked at.
    """
    return toxicity.score(docs, toxicity_model(spark, sf_dir)).where("predicted = 0").select(*docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id.

    Rows without id stay only in groups that have no other; of rows equal in id and text one stays; null texts and texts without words are one group. No rows give no rows.
    """
    return near_duplicates.one_per_component(docs).select(*docs.columns)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages go, and with them documents that they were all of; n_chars follows the text.

    A null text becomes the empty one and stays; rows of one id, or without id, take nothing from each other; a row without id comes after all others. No rows give no rows.
    """
    kept = repeated_passages.remove_repeats(docs).where("n_removed < n_bytes or n_bytes = 0")
    if "n_chars" in docs.columns:
        kept = kept.selectExpr("* except (n_chars)", "cast(length(text) as bigint) as n_chars")
    return kept.select(*docs.columns)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Each row is judged, with or without id; null and empty texts hold none and stay. No rows give no rows.
    """
    return decontamination.without_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their bins.

    A null text counts as empty and is one end mark; each of repeated rows is packed; a null id stays null. No rows give no rows.
    """
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("near_dedup", near_duplicates_out), ("suffix_dedup", repeats_out), ("decontamination", leaks_out), ("packing", packed)]
#: The stages use learned models and hashes that SQL has no words for; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
