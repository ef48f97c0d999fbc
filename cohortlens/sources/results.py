"""Writers of matches, scores, errors and predictions, and the reader of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.compare import identified

SCORE_SCHEMA = "model_type STRING, feature_set STRING, target STRING, keyword_category STRING, fold INT, split STRING, learning_curve_train_proportion DOUBLE, learning_curve_train_iteration INT, learning_curve_train_size INT, metric STRING, class STRING, score DOUBLE, support BIGINT"


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or CSV with a header and doubled quotes."""
    if kind == "csv":
        df.write.mode("overwrite").options(header="true", escape='"').csv(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("kind is 'parquet' or 'csv'")


def write_scores(scores: DataFrame, path: str) -> None:
    """JSON lines."""
    scores.write.mode("overwrite").json(path)


def read_scores(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """Scores from JSON lines, of the chosen models if ``names`` (model_type, feature_set, identifier, ord) is given."""
    scores = spark.read.schema(SCORE_SCHEMA).json(path)
    return identified(scores, names) if names is not None else scores


def write_errors(errors: DataFrame, path: str) -> None:
    """A folder per category, target, features, model and split, of those columns that there are."""
    keys = [c for c in ("keyword_category", "target", "feature_set", "model_type", "split") if c in errors.columns]
    errors.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_predictions(predictions: DataFrame, path: str, keep_text: bool = True) -> None:
    """A folder per category; without the notes' text if asked."""
    out = predictions if keep_text else predictions.drop("note_text")
    out.write.mode("overwrite").partitionBy("keyword_category").parquet(path)
