"""Queries that write their rows to files and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.models import load, save
from cohortlens.plans.common import table
from cohortlens.plans.models import _FOLDS, _fold_scores, _predicted, _PRED, _vectors
from cohortlens.sources import hospital, results
from cohortlens.sources.shared import shared_dir


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def notes_csv(spark: SparkSession, d: str) -> DataFrame:
    """Notes as Latin-1 CSV with texts of many lines."""
    path = _path(spark, "notes")
    notes = table(spark, d, "documents").select(F.concat(F.lit("n"), "doc_id").alias("note_id"), F.col("doc_id").alias("subject_id"), F.col("doc_id").alias("hadm_id"), F.lit("DS").alias("note_type"), F.lit(1).alias("note_seq"), F.lit("2100-01-01").alias("charttime"), F.lit("2100-01-02").alias("storetime"), F.concat(F.lit('say "x", '), F.regexp_replace("text", "[^\\x00-\\xff]", "")).alias("text"))
    notes.write.options(header="true", encoding="ISO-8859-1", escape='"').csv(path)
    return hospital.read_notes(spark, path).select("note_id", "subject_id", "note_seq", "text")


def sampled_notes(spark: SparkSession, d: str) -> DataFrame:
    """Whole chunks, then a share of each, of notes with their service and unit."""
    raw = table(spark, d, "documents").select(F.concat(F.lit("n"), "doc_id").alias("note_id"), F.col("doc_id").alias("position"), (F.col("doc_id") % 50).alias("subject_id"), F.lit(1).cast("long").alias("hadm_id"), F.lit("DS").alias("note_type"), F.lit(1).alias("note_seq"), F.lit("t").alias("charttime"), F.lit("t").alias("storetime"), "text")
    people = raw.select("subject_id", "hadm_id").distinct()
    services = people.select("subject_id", "hadm_id", F.timestamp_seconds("subject_id").alias("transfertime"), F.lit("MED").alias("curr_service"))
    stay = F.explode(F.array(*[F.struct(F.timestamp_seconds(F.lit(k)).alias("intime"), F.lit(None).cast("timestamp").alias("outtime"), F.lit(e).alias("eventtype"), F.lit(u).alias("careunit")) for k, (e, u) in enumerate((("admit", "Ward"), ("discharge", None)))]))
    transfers = people.select("subject_id", "hadm_id", stay.alias("s")).select("subject_id", "hadm_id", "s.*")
    return hospital.load_notes(raw, services, transfers, position_col="position", chunk_size=20, chunk_share=0.5, note_share=0.4).drop("position")


def table_csv(spark: SparkSession, d: str) -> DataFrame:
    """A table of codes as compressed CSV."""
    path = _path(spark, "diagnoses") + ".gz"
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber").alias("seq_num"), F.col("l_partkey").cast("string").alias("icd_code"), F.when(F.col("l_linestatus") == "F", 9).otherwise(10).alias("icd_version"))
    li.write.options(header="true", compression="gzip").csv(path)
    return hospital.read_table(spark, path, "diagnoses_icd")


def scores_json(spark: SparkSession, d: str) -> DataFrame:
    """Scores as JSON lines, read back for one chosen model."""
    path = _path(spark, "scores")
    rows = _fold_scores(spark, d).select(F.col("identifier").alias("model_type"), F.lit("f").alias("feature_set"), "keyword_category", "fold", "split", "metric", "score")
    results.write_scores(rows, path)
    names = spark.createDataFrame([("b", "f", "B", 0)], "model_type string, feature_set string, identifier string, ord int")
    return results.read_scores(spark, path, names).select("identifier", "keyword_category", "fold", "metric", F.round("score", 6).alias("score"))


def error_files(spark: SparkSession, d: str) -> DataFrame:
    """Errors in a folder per category and split."""
    path = _path(spark, "errors")
    wrong = _predicted(spark, d).where("y <> p").select("doc_id", "y", "p", F.col("lang").alias("keyword_category"), F.concat(F.lit("f"), "fold").alias("split"))
    results.write_errors(wrong, path)
    return spark.read.parquet(path).groupBy("keyword_category", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions in a folder per category, without text."""
    path = _path(spark, "predictions")
    rows = _predicted(spark, d).select("doc_id", "p", F.col("lang").alias("keyword_category"), F.lit("text").alias("note_text"))
    results.write_predictions(rows, path, keep_text=False)
    return spark.read.parquet(path)


def saved_model(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of a pipeline that was saved and loaded."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    path, rows = _path(spark, "model"), _vectors(spark, d)
    save(spark, Pipeline(stages=[LogisticRegression(labelCol="label_idx", maxIter=30)]).fit(rows.where("vec_id % 5 > 0")), path, ["0", "1", "2"])
    model, labels, _ = load(spark, path)
    names = F.array(*map(F.lit, labels))
    return model.transform(rows.where("vec_id % 5 = 0")).select("vec_id", "y", F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted_label"))


SQL = {
    "notes_csv": r"""select 'n' || doc_id as note_id, doc_id as subject_id, 1 as note_seq, 'say "x", ' || regexp_replace(text, '[^\x00-\x{ff}]', '', 'g') as text from documents""",
    "table_csv": "select l_suppkey as subject_id, l_orderkey as hadm_id, l_linenumber as seq_num, l_partkey::varchar as icd_code, case when l_linestatus = 'F' then 9 else 10 end as icd_version from lineitem",
    "scores_json": f"with {_FOLDS} select 'B' as identifier, keyword_category, fold, metric, round(score, 6) as score from fold_scores where identifier = 'b'",
    "error_files": f"with {_PRED} select lang as keyword_category, 'f' || fold as split, count(*) as n, sum(doc_id)::bigint as ids from pred where y <> p group by all",
    "prediction_files": f"with {_PRED} select doc_id, p, lang as keyword_category from pred",
}
QUERIES = {f.__name__: f for f in (notes_csv, sampled_notes, table_csv, scores_json, error_files, prediction_files, saved_model)}
