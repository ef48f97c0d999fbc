"""Token counts kept by digest: texts that a cache holds aren't encoded again."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import byte_slices, require, shared_dir, text_or_empty
from cohortlens.llm.encoding import count_tokens

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file: another version has other entries."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def cached_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Content is normalised only in that a null text is the empty one: the tokenizer has no normaliser, so
    any further step would change counts. The cache is a Parquet table of content digest (SHA-256 of the UTF-8
    text), tokenizer digest and count at ``cache_path`` (a new one in the shared folder by default). Digests
    that it lacks for this tokenizer are encoded once each, in the tasks, and appended. Repeated
    rows and equal texts share an entry; each row is returned. No rows give no rows. An entry may be in the cache several
    times, as when two jobs append at once; it counts as one.

    Equal texts meet once per map task before the shuffle, so a large group of copies costs as much as
    one text per task.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest")

    texts = docs.select(digest, text.alias("text")).groupBy("content_digest").agg(F.first("text").alias("text"))
    try:
        held = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        texts = texts.join(held.select("content_digest"), "content_digest", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in byte_slices(part, "text", 1 << 20):
                counts = count_tokens(tokenizer_path, some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("content_digest"), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    texts.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest)
    return rows.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
