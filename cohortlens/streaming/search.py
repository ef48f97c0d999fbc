"""Anchor search over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.lexicon import Lexicon
from cohortlens.operators.search import find_hits, search


def read_texts(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, glob: str = "*") -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)


def stream_search(stream: DataFrame, lexicon: Lexicon, context_size: int = 10, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Windows of every hit as texts arrive; no state."""
    return search(stream, lexicon, context_size, id_col, text_col)


def stream_counts(stream: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """Running hits per category and keyword; the state is a number per keyword."""
    return find_hits(stream, lexicon, text_col).groupBy("keyword_category", "keyword").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, lexicon: Lexicon, time_col: str, width: str, late: str, text_col: str = "text") -> DataFrame:
    """Hits per keyword and window of event time; windows close once the watermark, ``late`` behind, passes them."""
    hits = find_hits(stream.withWatermark(time_col, late), lexicon, text_col)
    return hits.groupBy(F.window(time_col, width), "keyword_category", "keyword").agg(F.count("*").alias("n")).select("window.start", "window.end", "keyword_category", "keyword", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Writes what is there to Parquet, exactly once across restarts, and reads it back."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
