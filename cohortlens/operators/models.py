"""The ladder of classifiers, from class shares to logistic regression and user-supplied networks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.operators.forests import Forest
from cohortlens.operators.many import Fit, Rows
from cohortlens.operators.metrics import scores
from cohortlens.operators.splits import constrained_resample, learning_curve
from cohortlens.sources.shared import stored

C_GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 5.0, 10.0)


def prior(train: DataFrame, label_col: str) -> DataFrame:
    """(label, p): each label's share of the labelled rows."""
    held = train.where(F.col(label_col).isNotNull())
    n = held.count()
    return held.groupBy(F.col(label_col).alias("label")).agg((F.count("*") / F.lit(max(n, 1))).alias("p"))


def most_frequent(train: DataFrame, label_col: str):
    """The commonest label, the least of several."""
    counts = train.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    row = counts.orderBy(F.desc("n"), "label").first()
    return row and row.label


@dataclass
class ConditionalMajority:
    """P(label | x) = (n_xy + alpha) / (n_x + alpha * labels); an x without train rows gets the same share for all."""

    alpha: float = 1.0
    labels: list = field(default_factory=list)
    table: DataFrame | None = None
    x_col: str = "x"

    def fit(self, train: DataFrame, x_col: str, label_col: str) -> ConditionalMajority:
        held = train.where(F.col(label_col).isNotNull())
        self.x_col = x_col
        self.labels = [r[0] for r in held.select(label_col).distinct().orderBy(label_col).collect()]  # a row per class
        counts = held.groupBy(x_col).agg(F.count("*").alias("n_x"), *[F.count_if(F.col(label_col) == y).alias(f"n_{k}") for k, y in enumerate(self.labels)])
        k = len(self.labels)
        p = F.array(*[(F.col(f"n_{i}") + self.alpha) / (F.col("n_x") + self.alpha * k) for i in range(k)])
        self.table = counts.where(F.col(x_col).isNotNull()).select(x_col, p.alias("probabilities"))
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with probabilities, in the order of ``labels``."""
        even = F.array(*[F.lit(1.0 / len(self.labels)) for _ in self.labels])
        return df.join(self.table, self.x_col, "left").withColumn("probabilities", F.coalesce("probabilities", even))

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with probabilities and predicted_label, the first of the likeliest."""
        return with_argmax(self.predict_proba(df), self.labels)

    def fit_predict(self, train: DataFrame, x_col: str, label_col: str) -> DataFrame:
        """Probabilities of the train rows themselves."""
        return self.fit(train, x_col, label_col).predict_proba(train)


def with_argmax(df: DataFrame, labels: Sequence, probabilities: str = "probabilities") -> DataFrame:
    """``df`` with predicted_label: the first label of greatest probability."""
    p = F.col(probabilities)
    names = F.array(*map(F.lit, labels))
    return df.withColumn("predicted_label", F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")))


def probability_columns(df: DataFrame, labels: Sequence[str], probabilities: str = "probabilities") -> DataFrame:
    """``df`` with one column per class instead of the array, by name."""
    place = {str(y): k for k, y in enumerate(labels)}
    return df.select(*[c for c in df.columns if c != probabilities], *[F.get(probabilities, F.lit(place[y])).alias(y) for y in sorted(place)])


def logistic(train: DataFrame, c: float | None, label_col: str = "label_idx", balanced: bool = True, max_iter: int = 200) -> LogisticRegressionModel:
    """Multinomial logistic regression with the L2 penalty of strength 1/c (none for null), rows weighted by class if ``balanced``."""
    total = None
    if balanced:
        n, k = train.agg(F.count("*"), F.count_distinct(label_col)).first()
        counts = train.groupBy(label_col).agg((F.lit(n / max(k, 1)) / F.count("*")).alias("__w"))
        train = train.join(F.broadcast(counts), label_col)  # a row per class
        total = float(n)
    else:
        train, total = train.withColumn("__w", F.lit(1.0)), float(train.count())
    reg = 0.0 if c is None else 1.0 / (c * max(total, 1.0))
    return LogisticRegression(labelCol=label_col, weightCol="__w", family="multinomial", standardization=False, regParam=reg, maxIter=max_iter, tol=1e-8).fit(train)


def predict_vectors(model, df: DataFrame, labels: Sequence) -> DataFrame:
    """``df`` with probabilities and predicted_label of an MLlib classifier."""
    out = model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    return with_argmax(out.drop("rawPrediction", "probability", "prediction"), labels)


def _macro_f1(predicted: DataFrame, label_col: str) -> float:
    return scores(predicted, label_col, "predicted_label").where("metric = 'macro_f1'").first().score or 0.0


def logistic_grid(train: DataFrame, dev: DataFrame, labels: Sequence, label_col: str = "label", grid: Sequence[float] = C_GRID, threads: int = 4) -> tuple[LogisticRegressionModel, float, list[tuple[float, float]]]:
    """The model whose strength does best on dev by macro F1, the first of several; that strength; and all (c, score).

    Fits share the session and run side by side.
    """
    train, dev = train.cache(), dev.cache()

    def one(c: float) -> tuple[LogisticRegressionModel, float]:
        model = logistic(train, c)
        return model, _macro_f1(predict_vectors(model, dev, labels), label_col)

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(one, grid))
    best = max(range(len(grid)), key=lambda k: (found[k][1], -k))
    train.unpersist()
    dev.unpersist()
    return found[best][0], grid[best], [(c, s) for c, (_, s) in zip(grid, found, strict=True)]


def forest_grid(train: DataFrame, dev: DataFrame, labels: Sequence, label_col: str = "label", trees: int = 100, depths: Sequence[int | None] = (None, 5, 10, 50), min_splits: Sequence[int] = (2, 5, 10), seed: int = 42):
    """The random forest whose depth and least rows to split do best on dev by macro F1, with all scores; depths end at 30, and shallower forests are deeper ones cut off."""
    settings = [(depth, least) for depth in depths for least in min_splits]
    same = {s: (min(s[0] or 30, 30), max(1, s[1] // 2)) for s in settings}
    grown, score = {}, {}
    for least in dict.fromkeys(rows for _, rows in same.values()):
        of = [d for d, rows in same.values() if rows == least]
        grown[least] = _forest(train, max(of), least, trees, seed)
        score |= {(d, least): f1 for d, f1 in _depth_scores(grown[least].votes(dev, of), of, labels, label_col).items()}
    found = [(s, score[same[s]]) for s in settings]
    best = max(range(len(found)), key=lambda k: (found[k][1], -k))
    depth, least = same[settings[best]]
    return grown[least].cut(depth), settings[best], found


def _depth_scores(said: DataFrame, depths: Sequence[int], labels: Sequence, label_col: str) -> dict[int, float]:
    """Macro F1 of the votes at each depth."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("__depth"), F.col(f"votes {d}").alias("__votes")) for d in sorted(set(depths))]))
    rows = with_argmax(said.select(label_col, each.alias("__of")).select(label_col, "__of.*"), labels, "__votes")
    found = {r["__depth"]: r.score for r in scores(rows, label_col, "predicted_label", ["__depth"]).where("metric = 'macro_f1'").collect()}  # a row per depth
    return {d: found.get(d) or 0.0 for d in depths}


def _forest(train: DataFrame, depth: int, least: int, trees: int, seed: int) -> Forest:
    return Forest(train, depth, least, trees, seed)


#: Row and tree pairs of the trees that are grown at a time: so many rows are shuffled.
_GROWN = 50_000_000


class _Votes:
    """The scores of a forest by depth; above ``_GROWN`` pairs of rows and trees it is grown a few trees at a time, each group's votes added to those before."""

    def __init__(self, trees: int, depths: Sequence[int], least: int, n: int, seed: int):
        each = max(1, min(trees, _GROWN // max(1, n)))
        self.groups = [(min(each, trees - i), seed + i) for i in range(0, trees, each)]
        self.depths, self.least = sorted(set(depths)), least

    def scores(self, train: DataFrame, test: DataFrame, labels: Sequence, label_col: str) -> dict[int, float]:
        said = None
        for trees, seed in self.groups:
            before = test if said is None else said.withColumnsRenamed({f"votes {d}": f"__before {d}" for d in self.depths})
            said = _forest(train, max(self.depths), self.least, trees, seed).votes(before, self.depths)
            if before is not test:
                said = said.withColumns({f"votes {d}": F.zip_with(f"votes {d}", f"__before {d}", lambda x, y: x + y) for d in self.depths}).drop(*[f"__before {d}" for d in self.depths])
        return _depth_scores(said, self.depths, labels, label_col)


def constrained_forest(rows: DataFrame, key: str, label_col: str, labels: Sequence, draws: int = 3, test_share: float = 0.2, min_train: int = 1, min_test: int = 1, trees: int = 100, depths: Sequence[int | None] = (None, 5, 10, 50), min_splits: Sequence[int] = (2, 5, 10), seed: int = 42, threads: int = 4, refit: bool = True):
    """(forest, (depth, least rows to split), scores): the settings of best mean macro F1 over ``draws`` constrained resamples, the first of several, fitted again on all rows.

    The draws are columns of one stored table; forests of one draw and least number of rows are the same trees cut off at each depth. Fits run side by side.
    Depths end at 30. Without ``refit`` the forest is null.
    """
    for i in range(draws):
        rows = constrained_resample(rows, key, label_col, test_share, min_train, min_test, seed + i).withColumnRenamed("part", f"__part{i}")
    held = stored(rows, "forest-rows")
    n = held.count()
    settings = [(depth, least) for depth in depths for least in min_splits]
    same = {s: (min(s[0] or 30, 30), max(1, s[1] // 2)) for s in settings}

    def one(what: tuple[int, int]) -> dict[tuple[int, int, int], float]:
        least, i = what
        of = [d for d, rows in same.values() if rows == least]
        found = _Votes(trees, of, least, n, seed).scores(held.where(F.col(f"__part{i}") == "train"), held.where(F.col(f"__part{i}") == "test"), labels, label_col)
        return {(d, least, i): score for d, score in found.items()}

    todo = [(least, i) for least in dict.fromkeys(rows for _, rows in same.values()) for i in range(draws)]
    with ThreadPoolExecutor(threads) as pool:
        found = reduce(lambda x, y: x | y, pool.map(one, todo), {})
    means = [(s, sum(found[*same[s], i] for i in range(draws)) / draws) for s in settings]
    best = max(range(len(means)), key=lambda k: (means[k][1], -k))
    return _forest(held, *same[means[best][0]], trees, seed) if refit else None, means[best][0], means


def coefficients(spark: SparkSession, model: LogisticRegressionModel, features: Sequence[str], labels: Sequence) -> DataFrame:
    """(feature, label, coefficient)."""
    rows = [(f, str(y), float(model.coefficientMatrix[k, j])) for k, y in enumerate(labels) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, label string, coefficient double")


def importances(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """(feature, importance) of a forest, averaged over its trees."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(values[j])) for j, f in enumerate(features)], "feature string, importance double")


def score_batches(df: DataFrame, make_model: Callable, input_col: str, width: int, output_type: str = "array<double>", output_col: str = "probabilities", batch_size: int = 32) -> DataFrame:
    """``df`` with the output of a user's model, made once per Python worker by ``make_model`` and called on batches of arrays of ``width`` numbers.

    Serves class probabilities and embeddings alike.
    """
    from pyspark.sql.types import _parse_datatype_string

    call = predict_batch_udf(make_model, return_type=_parse_datatype_string(output_type), batch_size=batch_size, input_tensor_shapes=[[width]])
    return df.withColumn(output_col, call(F.col(input_col)))


@dataclass
class Registered:
    """A model of the registry: its kind, and a folder per task."""

    kind: str
    tasks: Mapping[str, str]


class Registry:
    """Models by id; a model is a saved pipeline with its labels beside it."""

    def __init__(self, models: Mapping[str, Registered] | None = None):
        self.models = dict(models or {})

    def show(self, spark: SparkSession) -> DataFrame:
        """(model_id, kind, task, path)."""
        rows = [(i, m.kind, t, p) for i, m in self.models.items() for t, p in m.tasks.items()]
        return spark.createDataFrame(rows, "model_id string, kind string, task string, path string")

    def resolve(self, model: str, category: str, kind: str) -> str:
        """The folder of a model id, or the path itself; KeyError for an unknown task, ValueError for another kind."""
        if model not in self.models:
            return model
        held = self.models[model]
        if held.kind != kind:
            raise ValueError(f"{model} is of kind {held.kind}")
        if category not in held.tasks:
            raise KeyError(f"{model} has no task {category}")
        return held.tasks[category]


def save(spark: SparkSession, model: PipelineModel, path: str, labels: Sequence[str], parameters: Mapping[str, str] | None = None) -> None:
    """A pipeline with its labels and parameters as tables beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(list(enumerate(map(str, labels))), "label_idx int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
    spark.createDataFrame([(k, str(v)) for k, v in (parameters or {}).items()], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], dict[str, str]]:
    """What :func:`save` wrote."""
    labels = [r.label for r in spark.read.parquet(f"{path}/labels").orderBy("label_idx").collect()]
    return PipelineModel.load(f"{path}/model"), labels, {r.name: r.value for r in spark.read.parquet(f"{path}/parameters").collect()}


def sweep(rows: DataFrame, categories: Sequence[str], folds: Sequence[int], fits: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]], label_col: str = "label", threads: int = 4) -> DataFrame:
    """Scores of every category, fold and model. A fit takes train and dev rows and returns dev with predicted_label; independent fits run side by side."""

    def one(what: tuple[str, int, str]) -> DataFrame:
        category, fold, name = what
        held = rows.where(F.col("keyword_category") == category)
        predicted = fits[name](held.where(F.col("fold") != fold), held.where(F.col("fold") == fold))
        return scores(predicted, label_col, "predicted_label").select(F.lit(name).alias("model_type"), F.lit(category).alias("keyword_category"), F.lit(fold).alias("fold"), "metric", "score")

    todo = [(c, f, n) for c in categories for f in folds for n in fits]
    with ThreadPoolExecutor(threads) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, todo))


def logistic_sweep(rows: DataFrame, features: Sequence[str], category_col: str = "keyword_category", label_col: str = "label", row_id: str = "row_id", fold_col: str = "fold", grid: Sequence[float] = C_GRID, percents: Sequence[float] = (100,), iterations: int = 1, draw: Column | None = None, most_passes: int = 300) -> tuple[DataFrame, DataFrame]:
    """Logistic regressions of every category, fold, vector column of ``features``, learning-curve step and strength, fitted together.

    The first table has (keyword_category, feature_set, fold, percent, iteration, size, c, chosen, metric, score): the scores on the fold's rows of the model that learned from
    the step's rows of the other folds; chosen marks the strength of best macro F1, the least of several. The second has the chosen models' (keyword_category, feature_set, fold, percent, iteration, row_id, y_true, y_pred).
    Labels are numbered by name within their category, null ones go. Row ids are unique. A fold without rows to learn from or to score has no scores.
    """
    rows = rows.where(F.col(label_col).isNotNull() & F.col(category_col).isNotNull() & F.col(fold_col).isNotNull())
    named = {}
    for r in rows.select(category_col, label_col).distinct().orderBy(category_col, label_col).collect():  # a row per class
        named.setdefault(r[0], []).append(r[1])
    folds = [r[0] for r in rows.select(fold_col).distinct().orderBy(fold_col).collect()]
    runs = F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col(fold_col))
    spread = rows.select(row_id, category_col, label_col, F.explode(runs).alias("__run"))
    sets = learning_curve(spread, row_id, label_col, percents, iterations, by=[category_col, "__run"], draw=draw)
    name = F.concat_ws("|", "__run", "percent", "iteration")
    part_of = sets.groupBy(row_id).agg(F.collect_set(name).alias("__sets"))  # at most a name per fold and step
    sizes = {(r[0], r[1], r.percent, r.iteration): r["size"] for r in sets.groupBy(category_col, "__run", "percent", "iteration").agg(F.first("size").alias("size")).orderBy(category_col, "__run", "percent", "iteration").collect()}
    place = reduce(lambda w, c: w.when(F.col(category_col) == c, F.array_position(F.array(*map(F.lit, named[c])), F.col(label_col)) - 1), named, F.when(F.lit(False), F.lit(0)))
    held = rows.join(part_of, row_id, "left").withColumn("__y", place)
    masks = {f"train {k}": (F.col(category_col) == k[0]) & F.array_contains("__sets", "|".join(map(str, k[1:]))) for k in sizes}
    masks |= {f"dev {(c, f)}": (F.col(category_col) == c) & (F.col(fold_col) == f) for c, f in dict.fromkeys(k[:2] for k in sizes)}
    fits = [Fit((*k, v, c), v, f"train {k}", c) for k in sizes for v in features for c in sorted(grid)]  # a category's models are at work together, on the blocks of its rows only
    laid = Rows(held, row_id, "__y", masks, features)
    try:
        fitted = laid.fit(fits, most_passes=most_passes)
        predicted = stored(laid.predict(fitted, [f"dev {f.name[:2]}" for f in fits]).drop("probabilities"), "sweep")
    finally:
        laid.close()
    spark = rows.sparkSession
    kinds = rows.schema
    what = spark.createDataFrame([(i, *f.name, sizes[f.name[:4]]) for i, f in enumerate(fits)], f"fit int, keyword_category {kinds[category_col].dataType.simpleString()}, fold {kinds[fold_col].dataType.simpleString()}, percent double, iteration int, feature_set string, c double, size long")  # a row per model
    found = scores(predicted, "y", "predicted", ["fit"]).join(F.broadcast(what), "fit")
    f1 = F.max(F.when(F.col("metric") == "macro_f1", F.col("score"))).over(Window.partitionBy("fit"))
    task = Window.partitionBy("keyword_category", "feature_set", "fold", "percent", "iteration")
    best = F.max_by("fit", F.struct(F.col("__f1"), -F.col("c"))).over(task)
    found = stored(found.withColumn("__f1", f1).withColumn("chosen", F.col("fit") == best).drop("__f1"), "sweep-scores")
    label = reduce(lambda w, c: w.when(F.col("keyword_category") == c, F.element_at(F.array(*map(F.lit, named[c])), F.col("__k") + 1)), named, F.when(F.lit(False), F.lit(None).cast(kinds[label_col].dataType)))
    said = predicted.join(F.broadcast(found.where("chosen and metric = 'macro_f1'").select("fit", "keyword_category", "feature_set", "fold", "percent", "iteration")), "fit").withColumnRenamed("row_id", row_id)
    said = said.withColumn("__k", F.col("y")).withColumn("y_true", label).withColumn("__k", F.col("predicted")).withColumn("y_pred", label)
    keys = ["keyword_category", "feature_set", "fold", "percent", "iteration"]
    return found.select(*keys, "size", "c", "chosen", "metric", "score"), said.select(*keys, row_id, "y_true", "y_pred")
