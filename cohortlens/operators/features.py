"""Features as long tables (row_id, component, feature, value), vectors only where MLlib wants them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.guards import none_left
from cohortlens.sources.shared import stored


def target_encoding(df: DataFrame, label_col: str) -> DataFrame:
    """(label, n, label_idx): labels by rising count, ties by label; null labels don't count. One row per label."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("label_idx", F.row_number().over(Window.orderBy("n", "label")) - 1)


def encode_targets(df: DataFrame, label_col: str, labels: DataFrame) -> DataFrame:
    """``df`` with label_idx, null for labels that ``labels`` lacks."""
    return df.join(F.broadcast(labels.select(F.col("label").alias(label_col), "label_idx")), label_col, "left")  # a row per class


def one_hot(df: DataFrame, row_id: str, source_col: str, component: str, train: Column | None = None) -> DataFrame:
    """1 for the row's value, if a train row has it; rows of other values have no features."""
    fit = (df if train is None else df.where(train)).select(source_col).where(F.col(source_col).isNotNull()).distinct()
    return df.join(fit, source_col, "left_semi").select(F.col(row_id).alias("row_id"), F.lit(component).alias("component"), F.col(source_col).cast("string").alias("feature"), F.lit(1.0).alias("value"))


#: The most rows, and the most bytes of names, of a table of terms that is sent to tasks.
_SENT = 1 << 20, 32 << 20


def sent(terms: DataFrame, name_col: str) -> DataFrame:
    """``terms``, stored, and to be broadcast in joins if they are at most 1,048,576 rows with 32 MB of names."""
    held = stored(terms, "terms")
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(name_col)), F.lit(0))).first()
    return F.broadcast(held) if n <= _SENT[0] and size <= _SENT[1] else held


def count_features(df: DataFrame, row_id: str, tokens_col: str, vocabulary: DataFrame, component: str = "tokens") -> DataFrame:
    """How often each token of the vocabulary is in a row."""
    tokens = df.select(F.col(row_id).alias("row_id"), F.explode(tokens_col).alias("token"))
    counts = tokens.groupBy("row_id", "token").agg(F.count("*").cast("double").alias("value"))
    return counts.join(vocabulary.select("token"), "token", "left_semi").select("row_id", F.lit(component).alias("component"), F.col("token").alias("feature"), "value")


def idf(counts: DataFrame, n_rows: int) -> DataFrame:
    """(component, feature, idf): ln((1 + n) / (1 + df)) + 1 over the given rows."""
    df_ = counts.where("value > 0").groupBy("component", "feature").agg(F.count_distinct("row_id").alias("df"))
    return df_.select("component", "feature", (F.log(F.lit(1.0 + n_rows) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, weights: DataFrame, norm: str | None = "l2") -> DataFrame:
    """Counts times idf, each row scaled to length 1 ("l1", "l2" or None); features without a weight go."""
    out = counts.join(weights, ["component", "feature"]).withColumn("value", F.col("value") * F.col("idf"))
    if norm:
        row = Window.partitionBy("row_id", "component")
        size = F.sqrt(F.sum(F.col("value") * F.col("value")).over(row)) if norm == "l2" else F.sum(F.abs("value")).over(row)
        out = out.withColumn("value", F.coalesce(F.try_divide(F.col("value"), size), F.lit(0.0)))
    return out.select("row_id", "component", "feature", "value")


def interactions(a: DataFrame, b: DataFrame, component: str) -> DataFrame:
    """Products of two components' values per row, named (c=v)x(c=v)."""
    name = lambda x: F.concat(F.lit("("), F.col(f"{x}.component"), F.lit("="), F.col(f"{x}.feature"), F.lit(")"))
    both = a.alias("a").join(b.alias("b"), F.col("a.row_id") == F.col("b.row_id"))
    return both.select(F.col("a.row_id"), F.lit(component).alias("component"), F.concat(name("a"), F.lit("x"), name("b")).alias("feature"), (F.col("a.value") * F.col("b.value")).alias("value"))


def represent(components: Mapping[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """The named components as one long table; KeyError for a name that isn't there."""
    unknown = [n for n in names if n not in components]
    if unknown:
        raise KeyError(f"unknown components: {unknown}")
    return reduce(DataFrame.unionByName, [components[n] for n in names])


def feature_index(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """(component, feature, index): components in the given order, features by name within one.

    The distinct features are sorted into ranges and written with their range; they are numbered inside it, after the sizes of the ranges before.
    """
    place = F.array_position(F.array(*map(F.lit, names)), F.col("component"))
    held = features.select("component", "feature").distinct().withColumn("place", place)
    held = stored(held.repartitionByRange("place", "component", "feature").withColumn("range", F.spark_partition_id()), "features")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = held.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("place", "component", "feature")) - 1
    return held.withColumn("at", inside).join(F.broadcast(starts), "range").select("component", "feature", (F.col("first") + F.col("at")).cast("int").alias("index"))


def same_features(learned: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` itself; ValueError if its (component, feature) list isn't the learned one. Both are vocabularies of components, not rows."""
    keys = ["component", "feature"]
    missing = learned.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti").withColumn("state", F.lit("missing"))
    new = found.select(*keys).distinct().join(learned.select(*keys).distinct(), keys, "left_anti").withColumn("state", F.lit("unknown"))
    none_left(missing.unionByName(new), "features that differ from the learned ones")
    return found


def standardize(df: DataFrame, cols: Sequence[str], train: Column | None = None, center: bool = True, scale: bool = True) -> DataFrame:
    """Columns less the train rows' mean, over their population deviation; constant columns are divided by 1."""
    fit = df if train is None else df.where(train)
    stats = fit.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    for c in cols:
        x = F.col(c) - (stats[f"m_{c}"] or 0.0) if center else F.col(c)
        df = df.withColumn(c, x / (stats[f"s_{c}"] or 1.0) if scale else x)
    return df


def standardize_vectors(df: DataFrame, train: DataFrame, col: str = "features") -> DataFrame:
    """Vectors centred and scaled by the train rows, with the population deviation (MLlib's is the sample one)."""
    n = train.count()
    model = StandardScaler(inputCol=col, outputCol="__z", withMean=True, withStd=True).fit(train)
    root = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    return model.transform(df).withColumn(col, array_to_vector(F.transform(vector_to_array("__z"), lambda x: x * root))).drop("__z")


def crosses(df: DataFrame, row_id: str, cols: Sequence[str], order: int = 3) -> DataFrame:
    """One-hots of each column and of every tuple of up to ``order`` of them."""
    from itertools import combinations

    parts = [F.struct(F.lit("&".join(some)).alias("component"), F.concat_ws("&", *[F.col(c).cast("string") for c in some]).alias("feature")) for k in range(1, order + 1) for some in combinations(cols, k)]
    return df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*parts)).alias("x")).select("row_id", "x.component", "x.feature", F.lit(1.0).alias("value"))


def class_weights(df: DataFrame, label_col: str, task_col: str | None = None, classes: DataFrame | None = None) -> DataFrame:
    """Balanced weights n / (classes * count) per label, within each task if given; 1 for a class of ``classes`` without rows."""
    task = [F.col(task_col).alias("task")] if task_col else []
    names = ["task"] if task_col else []
    counts = df.where(F.col(label_col).isNotNull()).groupBy(*task, F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    if classes is not None:
        counts = classes.join(counts, [*names, "label"], "left").fillna(0, ["n"])
    each = Window.partitionBy(*names)
    k = F.count("*").over(each)
    return counts.withColumn("weight", F.when(F.col("n") > 0, F.sum("n").over(each) / (k * F.col("n"))).otherwise(1.0))


def task_weights(df: DataFrame, task_col: str) -> DataFrame:
    """(task, n, weight): the inverse of each task's share of the rows."""
    counts = df.groupBy(F.col(task_col).alias("task")).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.sum("n").over(Window.partitionBy()) / F.col("n"))  # a row per task


def label_ids(df: DataFrame, task_col: str, label_col: str) -> DataFrame:
    """(task, label, task_id, label_id): ids by name, labels within their task."""
    held = df.select(F.col(task_col).alias("task"), F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return held.withColumn("task_id", F.dense_rank().over(Window.orderBy("task")) - 1).withColumn("label_id", F.dense_rank().over(Window.partitionBy("task").orderBy("label")) - 1)


def anchor_mask(tokens: Column, keyword: Column, mode: str = "keyword", special: Sequence[str] = ("[CLS]", "[SEP]")) -> Column:
    """Which tokens a pooled vector is made of.

    none and all: every token; cls: the first; all_no_special: all but special ones; keyword_all: every
    place of the keyword's tokens; keyword: the place that starts nearest to the middle (the first of two).
    """
    if mode in ("none", "all"):
        return F.transform(tokens, lambda _: F.lit(True))
    if mode == "cls":
        return F.transform(tokens, lambda _, i: i == 0)
    if mode == "all_no_special":
        return F.transform(tokens, lambda t: ~t.isin(list(special)))
    if mode not in ("keyword", "keyword_all"):
        raise KeyError(f"unknown mask: {mode}")
    n = F.size(keyword)
    found = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: (n > 0) & (F.slice(tokens, i + 1, n) == keyword))
    middle = F.floor(F.size(tokens) / 2)

    def mask(starts: Column) -> Column:
        if mode == "keyword":
            best = F.array_min(F.transform(starts, lambda i: F.struct(F.abs(i - middle).alias("d"), i.alias("i"))))["i"]
            return _bound(F.coalesce(best, F.lit(-1)), lambda b: F.transform(tokens, lambda _, i: (b >= 0) & (i >= b) & (i < b + n)))
        inside = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + n - 1)))
        return _bound(F.array_distinct(inside), lambda at: F.transform(tokens, lambda _, i: F.array_contains(at, i)))

    return _bound(found, mask)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is worked out once and not at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_pool(df: DataFrame, row_id: str, vectors_col: str, mask_col: str | None = None) -> DataFrame:
    """(row_id, vector): the mean of a row's token vectors where the mask holds. Null vectors don't count."""
    kept = F.col(vectors_col) if mask_col is None else F.transform(F.filter(F.arrays_zip(F.col(vectors_col).alias("v"), F.col(mask_col).alias("m")), lambda x: x["m"]), lambda x: x["v"])
    return mean_vectors(df.select(F.col(row_id).alias("row_id"), F.explode(kept).alias("v")), "row_id", "v")


def mean_vectors(df: DataFrame, row_id: str, vector_col: str) -> DataFrame:
    """(row_id, vector): the mean of the arrays of each id, which are of one length and have no null numbers; null arrays don't count. A task sends one sum per id."""
    rows = df.where(F.col(vector_col).isNotNull()).select(F.col(row_id).alias("row_id"), array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    return rows.groupBy("row_id").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("vector"))


#: Keywords that are analysed together.
KEYWORD_GROUPS = {
    "adamant": [
        ["claim", "claims", "claimed", "claiming"],
        ["insist", "insists", "insisted", "insisting", "insistence"],
        ["adamant", "adament", "adamantly", "adamently"],
    ],
    "compliance": [
        ["adhere", "adheres", "adhered", "adherance", "adherence", "adherent", "adhering", "nonadherance", "nonadherence", "nonadherent"],
        ["compliance", "compliant", "complies", "complied", "comply", "complying", "noncompliance", "noncompliant"],
        ["declined", "declines", "declining"],
        ["refuse", "refusal", "refused", "refuses", "refusing"],
    ],
    "other": [
        ["aggressive", "aggressively", "aggression", "angry", "anger", "angers", "angered", "angrily", "angrier", "agitated", "agitation"],
        ["argumentative", "argumentatively", "belligerence", "belligerent", "belligerently", "combative", "confronted", "confrontational", "defensive"],
        ["charming", "pleasant", "pleasantly", "lovely", "delightful", "well groomed", "well-groomed"],
        ["poorly groomed", "poorly-groomed", "unkempt", "disheveled"],
        ["drug-seeking", "drug seeking", "narcotic-seeking", "narcotic seeking", "secondary gain", "malinger", "malingers", "malingered", "malingerer", "malingering"],
        ["cooperative", "cooperate", "cooperates", "cooperated", "cooperation", "cooperating", "uncooperative"],
        ["historian"],
        ["exaggerate", "exaggerates", "exaggerating"],
        ["unmotivated", "unwilling", "unwillingly"],
        ["perseverate", "perseverates", "perseverated", "perseveration", "perseverating"],
    ],
}

Groups = Mapping[str, Sequence[Sequence[str]]]


def disjoint(groups: Groups) -> Groups:
    """The groups themselves; ValueError if two groups of a category share a keyword."""
    for c, gs in groups.items():
        words = [w for g in gs for w in g]
        if len(words) != len(set(words)):
            raise ValueError(f"groups of {c} share a keyword")
    return groups


def select_groups(names: Sequence[str], groups: Groups = KEYWORD_GROUPS) -> dict[str, Sequence[Sequence[str]]]:
    """The groups of the named categories; KeyError for an unknown one, ValueError if groups overlap."""
    unknown = [n for n in names if n not in groups]
    if unknown:
        raise KeyError(f"unknown categories: {unknown}")
    return {n: disjoint(groups)[n] for n in names}


def labelled_set(df: DataFrame, category: str, label_col: str, groups: Sequence[str] = ()) -> DataFrame:
    """The category's labelled rows with label_idx; group columns that aren't there are named in a warning and left out."""
    missing = [g for g in groups if g not in df.columns]
    if missing:
        warnings.warn(f"missing group columns: {missing}", stacklevel=2)
    rows = df.where((F.col("keyword_category") == category) & F.col(label_col).isNotNull())
    return encode_targets(rows, label_col, target_encoding(rows, label_col))
