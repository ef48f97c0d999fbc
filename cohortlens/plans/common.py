"""What the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A draw that SQL can repeat: a permutation of residues.
MODULUS = 1_000_003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draw(key: str | Column, seed: int = 42) -> Column:
    return ((F.col(key) if isinstance(key, str) else key) * 7919 + seed) % MODULUS


def draw_sql(key: str, seed: int = 42) -> str:
    return f"(({key}) * 7919 + {seed}) % {MODULUS}"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: four classes, language and source as attributes."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (2 * F.col("quality") + F.col("toxic")).cast("int").alias("y"), "quality", "toxic")
    return table(spark, sf_dir, "documents").join(labels, "doc_id")


LABELLED = "labelled as (select d.*, cast(2 * quality + toxic as int) as y, quality, toxic from documents d join labels using (doc_id))"
