"""Checks that raise before a job runs on wrong input."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself; KeyError that lists every column it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def none_left(bad: DataFrame, message: str, show: int = 5) -> None:
    """ValueError with a few of the rows of ``bad``, if it has any."""
    rows = bad.limit(show).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")


def validate_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """FileNotFoundError that lists every path of ``paths`` that Spark can't read."""
    missing = []
    for name, path in paths.items():
        try:
            spark.read.text(path).schema  # noqa: B018 - resolves the path only
        except AnalysisException:
            missing.append(f"{name} ({path})")
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")
