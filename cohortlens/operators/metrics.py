"""Evaluation of predictions: confusion counts, scores, ROC curves, errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(df: DataFrame, by: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in by]


def confusion(df: DataFrame, truth: str, predicted: str, labels: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., y_true, y_pred, n); with ``labels`` (column label), pairs without rows too.

    The grid is the labels' square per group, a few rows, made from labels alone.
    """
    counts = df.groupBy(*_by(df, by), F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("n"))
    if labels is None:
        return counts
    names = [r[0] for r in labels.select("label").distinct().collect()]  # a row per class
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred")) for a in names for b in names]))
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
    grid = groups.select(*by, pairs.alias("p")).select(*by, "p.*")
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").fillna(0, ["n"])


def per_class(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """(by..., label, support, predicted, correct, precision, recall, f1) for every label in truth or prediction; 0 for 0/0.

    With ``labels``, for those, in rows or not.
    """
    both = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hit = (F.col(truth) == F.col(predicted)).cast("int").alias("hit")
    counts = df.select(*by, hit, both.alias("x")).groupBy(*by, "x.label").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.col("hit") * F.col("x.t")).alias("correct"))
    if labels is not None:
        names = [r[0] for r in labels.select("label").distinct().collect()]  # a row per class
        groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
        counts = groups.select(*by, F.explode(F.array(*map(F.lit, names))).alias("label")).join(counts, [*by, "label"], "left").fillna(0, ["support", "predicted", "correct"])
    precision, recall = (F.coalesce(F.try_divide("correct", c), F.lit(0.0)) for c in ("predicted", "support"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("correct"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1})


def scores(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """(by..., metric, score): accuracy, and macro and micro precision, recall and F1."""
    c = per_class(df, truth, predicted, by, labels)
    micro_p, micro_r = F.try_divide(F.sum("correct"), F.sum("predicted")), F.try_divide(F.sum("correct"), F.sum("support"))
    wide = c.groupBy(*by).agg(
        F.coalesce(micro_r, F.lit(0.0)).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        F.coalesce(micro_p, F.lit(0.0)).alias("micro_precision"), F.coalesce(micro_r, F.lit(0.0)).alias("micro_recall"), F.coalesce(F.try_divide(2.0 * F.sum("correct"), F.sum("predicted") + F.sum("support")), F.lit(0.0)).alias("micro_f1"),
    )
    names = [x for x in wide.columns if x not in by]
    return wide.unpivot(list(by), names, "metric", "score") if by else wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("score")) for n in names])).alias("x")).select("x.*")


def roc_curve(df: DataFrame, positive: Column, score: str, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """(by..., threshold, neg, pos, fp, tp, n_neg, n_pos, fpr, tpr): one point per distinct score, with its own rows and those down to it.

    Equal scores are counted together first. Running sums go over the scores inside one of ``bins`` steps per unit of score,
    after the sums of the steps above, so that no task holds a whole curve of probabilities. Each curve begins at the origin, which is not among
    the points.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(F.sum((~positive).cast("int")).alias("neg"), F.sum(positive.cast("int")).alias("pos"))
    counts = counts.withColumn("step", F.floor(F.col("threshold") * bins))
    all_ = Window.partitionBy(*by)
    above = all_.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.groupBy(*by, "step").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    zero = F.lit(0).cast("long")
    starts = steps.select(*by, "step", F.coalesce(F.sum("neg").over(above), zero).alias("fp0"), F.coalesce(F.sum("pos").over(above), zero).alias("tp0"), F.sum("neg").over(all_).alias("n_neg"), F.sum("pos").over(all_).alias("n_pos"))
    upto = Window.partitionBy(*by, "step").orderBy(F.desc("threshold"))
    c = counts.join(starts, [*by, "step"]).select(*by, "threshold", "neg", "pos", (F.col("fp0") + F.sum("neg").over(upto)).alias("fp"), (F.col("tp0") + F.sum("pos").over(upto)).alias("tp"), "n_neg", "n_pos")
    return c.withColumns({"fpr": F.try_divide("fp", "n_neg"), "tpr": F.try_divide("tp", "n_pos")})


def thinned(curve: DataFrame, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """The curve without points that lie on the line between their neighbours.

    Neighbours are found inside one of ``bins`` steps per unit of threshold; the first and last point of a step get theirs from the nearest
    steps that have points, so only a table of two points per step is ordered as a whole.
    """
    point = F.struct("fp", "tp")
    curve = curve.withColumn("__step", F.floor(F.col("threshold") * bins))
    whole = Window.partitionBy(*by).orderBy(F.desc("__step"))
    ends = curve.groupBy(*by, "__step").agg(F.max_by(point, "threshold").alias("__first"), F.min_by(point, "threshold").alias("__last"))
    ends = ends.select(F.col("__step").alias("__of___step"), *[F.col(c).alias(f"__of_{c}") for c in by], F.lag("__last").over(whole).alias("__before"), F.lead("__first").over(whole).alias("__after"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*by, "__step")])
    w = Window.partitionBy(*by, "__step").orderBy(F.desc("threshold"))
    near = curve.withColumns({"__p": F.lag(point).over(w), "__n": F.lead(point).over(w)}).join(ends, same)
    p, n = F.coalesce("__p", "__before"), F.coalesce("__n", "__after")
    dx0, dy0 = F.col("fp") - F.coalesce(p["fp"], F.lit(0)), F.col("tp") - F.coalesce(p["tp"], F.lit(0))
    on = dx0 * (n["tp"] - F.col("tp")) == (n["fp"] - F.col("fp")) * dy0
    return near.where(~F.coalesce(on, F.lit(False))).drop("__step", "__p", "__n", "__before", "__after", "__of___step", *[f"__of_{c}" for c in by])


def auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc) by the trapezoid rule, from each point's own rows and sums; null if a class is absent."""
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    return curve.groupBy(*by).agg(F.try_divide(area, F.max("n_neg").cast("double") * F.max("n_pos")).alias("auc"))


def group_scores(df: DataFrame, truth: str, predicted: str, groups: Sequence[str], labels: DataFrame | None = None) -> DataFrame:
    """Scores, support and class balance per value of each group column, and overall per column.

    Overall macro scores take all ``labels``, those of a value the labels it has.
    """
    rows = df.select(truth, predicted, F.explode(F.array(*[F.struct(F.lit(g).alias("group_category"), F.col(g).cast("string").alias("group_subcategory")) for g in groups])).alias("g")).select(truth, predicted, "g.*")
    by = ["group_category", "group_subcategory"]

    def wide(part: DataFrame, full: DataFrame | None) -> DataFrame:
        s = scores(part, truth, predicted, by, full).where(F.col("metric").isin("accuracy", "macro_f1", "macro_precision", "macro_recall"))
        s = s.groupBy(*by).pivot("metric", ["accuracy", "macro_f1", "macro_precision", "macro_recall"]).agg(F.first("score"))
        return s.withColumnsRenamed({"macro_f1": "f1", "macro_precision": "precision", "macro_recall": "recall"}).join(balance(part, truth, by), by)

    values = rows.where(F.col("group_subcategory").isNotNull())
    overall = rows.withColumn("group_subcategory", F.lit("overall"))
    return wide(values, None).unionByName(wide(overall, labels))


def balance(df: DataFrame, truth: str, by: Sequence[str]) -> DataFrame:
    """(by..., support, class_balance): how many rows each label has, as a map."""
    counts = df.groupBy(*by, F.col(truth).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.sum("n").alias("support"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("class_balance"))


def errors(predicted: DataFrame, truth: str, prediction: str, row_id: str, source: DataFrame | None = None) -> DataFrame:
    """Rows whose prediction is wrong, joined with their source by key."""
    wrong = predicted.where(~F.col(truth).eqNullSafe(F.col(prediction)))
    if source is None:
        return wrong
    return wrong.join(source.drop(*[c for c in source.columns if c in wrong.columns and c != row_id]), row_id)


def mean_and_error(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by..., mean, std_error): over values that are there; null for none, error 0 for one."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    n = F.count(v)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)) / F.sqrt(n)).alias("std_error"))


def task_loss(df: DataFrame, task: str, p_true: str, weight: Column | None = None) -> DataFrame:
    """(task, n, loss): weighted cross-entropy per row, averaged over a task's rows."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(F.col(task).alias("task")).agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(F.col(p_true), F.lit(1e-300))) * w).alias("loss"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
