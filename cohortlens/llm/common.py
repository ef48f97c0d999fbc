"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Where it is unset, a session on one machine gets a temporary folder, and one on a cluster a ValueError."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_slices(part: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``part`` in order, in slices whose ``column`` has about ``most`` bytes (a longer row is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), part.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield part.slice(a, b - a)


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def text_or_empty(column: str | Column = "text") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int, text_col: str, label_col: str, id_col: str) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """((text, label) of at most ``most_rows`` labelled documents, half of each label by a hash of the id; how many ids each label has).

    The ids are chosen first; at most ``most_rows`` of them are broadcast, so no text is shuffled. Texts are whole. A null label or id counts as no label.
    """
    require(labels, id_col, label_col)
    held = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    seen = {r["__label"]: r["count"] for r in held.groupBy("__label").count().collect()}  # two rows
    order = [F.xxhash64("__id"), F.col("__id")]
    ids = held.where("__label = 0").orderBy(*order).limit(most_rows // 2).union(held.where("__label = 1").orderBy(*order).limit(most_rows // 2))
    texts = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    found = texts.join(F.broadcast(ids), "__id").distinct().collect()  # at most most_rows texts, but for repeated ids
    rows = sorted({(r["__id"], r["__text"], r["__label"]) for r in found}, key=lambda r: (r[0], r[1]))
    return [(text, label) for _, text, label in rows], seen
