"""Comparison of models over folds, training sizes and groups."""

from __future__ import annotations

import math
from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.metrics import mean_and_error

#: Names of metrics that different trainers write differently.
METRIC_NAMES = {"macro_f1": "f1", "macro_precision": "precision", "macro_recall": "recall", "f1-score": "f1", "auc": "roc_auc"}


def flatten_scores(overall: DataFrame, per_class: DataFrame, by: Sequence[str]) -> DataFrame:
    """One long table (by..., metric, class, score, support): overall scores have no class; metric names are unified."""
    name = F.col("metric")
    for old, new in METRIC_NAMES.items():
        name = F.when(F.col("metric") == old, new).otherwise(name)
    a = overall.select(*by, name.alias("metric"), F.lit(None).cast("string").alias("class"), F.col("score").cast("double"), F.lit(None).cast("long").alias("support"))
    kinds = [c for c in ("precision", "recall", "f1", "roc_auc") if c in per_class.columns]
    long = per_class.select(*by, F.col("label").cast("string").alias("class"), "support", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("score")) for k in kinds])).alias("x"))
    return a.unionByName(long.select(*by, "x.metric", "class", "x.score", "support"))


def identified(scores: DataFrame, names: DataFrame) -> DataFrame:
    """Scores of the chosen (model_type, feature_set) pairs with their display name and its place."""
    return scores.join(F.broadcast(names.select("model_type", "feature_set", "identifier", "ord")), ["model_type", "feature_set"])  # a row per model


def identifiers(names: DataFrame) -> list[str]:
    return [r.identifier for r in names.orderBy("ord").select("identifier").collect()]


def metric_table(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and standard error at full training size; of the majority models, which repeat per feature set, one row each."""
    if "learning_curve_train_proportion" in scores.columns:
        scores = scores.where(F.coalesce(F.col("learning_curve_train_proportion"), F.lit(100.0)) == 100.0)
    return mean_and_error(scores, "score", by)


def learning_curve_table(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, error and median training size by share of training rows."""
    v = F.col("score").cast("double")
    n = F.count(v)
    return scores.groupBy(*by, "learning_curve_train_proportion").agg(F.avg(v).alias("mean"), F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)) / F.sqrt(n)).alias("std_error"), F.percentile("learning_curve_train_size", 0.5).alias("train_size"))


def group_table(scores: DataFrame, metrics: Sequence[str] = ("accuracy", "f1", "precision", "recall")) -> DataFrame:
    """Group scores averaged over folds, with support summed."""
    return scores.groupBy("model_type", "split", "group_category", "group_subcategory").agg(*[F.avg(m).alias(m) for m in metrics], F.sum("support").alias("support"))


def class_scores(scores: DataFrame) -> DataFrame:
    """(metric, class, identifier, mean, std, std_error, support): scores over folds by class, "overall" for those without one, support summed; curves and grids are left out."""
    v = F.col("score").cast("double")
    std = F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    kept = scores.where(~F.col("metric").isin("confusion", "roc_auc")).withColumn("class", F.coalesce("class", F.lit("overall")))
    return kept.groupBy("metric", "class", "identifier").agg(F.avg(v).alias("mean"), std.alias("std"), (std / F.sqrt(F.count(v))).alias("std_error"), F.sum("support").alias("support"))


def normalised_confusion(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts summed over folds, and each as a share of its true label's; 0 for a label without rows."""
    summed = counts.groupBy(*by, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    row = Window.partitionBy(*by, "y_true")
    return summed.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(row)), F.lit(0.0)))


def confusion_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., accuracy, precision, recall, f1) from confusion counts, macro over the labels that truth has."""
    side = F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"))))
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")
    c = counts.select(*by, hit, side.alias("x")).groupBy(*by, "x.label").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum(F.when(F.col("x.t") > 0, F.col("hit")).otherwise(0)).alias("c")).where("t > 0")
    each = [F.coalesce(F.try_divide("c", "p"), F.lit(0.0)), F.try_divide("c", "t"), F.coalesce(F.try_divide(2.0 * F.col("c"), F.col("p") + F.col("t")), F.lit(0.0))]
    return c.groupBy(*by).agg((F.sum("c") / F.sum("t")).alias("accuracy"), *[F.avg(x).alias(n) for x, n in zip(each, ("precision", "recall", "f1"), strict=True)])


def mean_auc(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean AUC per class with its error."""
    return mean_and_error(scores.where("metric = 'roc_auc'"), "score", [*by, "class"])


def coefficient_table(coefficients: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(all features' mean and error per label, the ``k`` highest per label)."""
    table = mean_and_error(coefficients, "coefficient", ["label", "feature"])
    order = Window.partitionBy("label").orderBy(F.desc("mean"), "feature")
    return table, table.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def label_bias(df: DataFrame, category: str, feature: str, target: str) -> DataFrame:
    """(category, feature, target, n, share): counts of the target by feature, an "overall" feature added, as shares of the feature's rows."""
    rows = df.select(F.col(category).alias("category"), F.col(target).cast("string").alias("target"), F.explode(F.array(F.col(feature).cast("string"), F.lit("overall"))).alias("feature"))
    counts = rows.groupBy("category", "feature", "target").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("category", "feature")))


def summary(scores: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Mean and sample deviation by split, metric and identifier, a pair of columns per category."""
    return scores.groupBy("split", "metric", "identifier").pivot("keyword_category", list(categories)).agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))


def display(table: DataFrame, names: DataFrame) -> DataFrame:
    """The summary in the order of the identifiers."""
    return table.join(F.broadcast(names.select("identifier", "ord")), "identifier").orderBy("split", "metric", "ord").drop("ord")  # a row per model


def t_two_sided(t: Column, df: int) -> Column:
    """P(|T| >= |t|) of Student's t with a whole number of degrees of freedom (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    theta = F.atan(F.abs(t) / math.sqrt(df))
    cos2 = F.pow(F.cos(theta), 2)
    if df % 2:
        total, term = F.lit(0.0), F.cos(theta)
        for k in range(1, (df - 1) // 2 + 1):
            total = total + term
            term = term * cos2 * (2.0 * k / (2 * k + 1))
        inside = (2 / math.pi) * (theta + F.sin(theta) * total)
    else:
        total, term = F.lit(0.0), F.lit(1.0)
        for k in range(1, df // 2 + 1):
            total = total + term
            term = term * cos2 * ((2.0 * k - 1) / (2 * k))
        inside = F.sin(theta) * total
    return F.lit(1.0) - inside


def paired_t_tests(scores: DataFrame, folds: int, by: Sequence[str] = ("split", "metric", "keyword_category"), name: str = "identifier") -> DataFrame:
    """(by..., a, b, p_value) of paired t-tests over folds for all pairs of models; 1 on the diagonal and where folds never differ.

    Degrees of freedom come from the folds that both models have (``folds`` at most); with one fold there is no value. Models are few; what is joined are their scores per fold.
    """
    a = scores.select(*by, "fold", F.col(name).alias("a"), F.col("score").alias("x"))
    b = scores.select(*by, "fold", F.col(name).alias("b"), F.col("score").alias("y"))
    d = F.col("x") - F.col("y")
    s = a.join(b, [*by, "fold"]).groupBy(*by, "a", "b").agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.count("*").alias("n"))
    t = F.try_divide(F.col("m") * F.sqrt("n"), F.col("s"))
    p = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("n") < 2, F.lit(None).cast("double")).when(F.col("s") == 0, F.when(F.col("m") == 0, 1.0).otherwise(0.0)).otherwise(reduce(lambda x, n: x.when(F.col("n") == n, t_two_sided(t, n - 1)), range(3, folds + 1), F.when(F.col("n") == 2, t_two_sided(t, 1))))
    return s.select(*by, "a", "b", p.alias("p_value"))


def available_splits(scores: DataFrame) -> DataFrame:
    """(keyword_category, splits), the splits in order."""
    return scores.groupBy("keyword_category").agg(F.array_sort(F.collect_set("split")).alias("splits"))
