"""Splits, folds and samples, drawn by a hash so that they don't depend on partitions.

``draw`` may be given where the order must follow a known formula; by default it is a hash of key and seed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.guards import none_left

#: Ranges of the drawn number in which rows are numbered.
RANGES = 1024


def drawn(key: str | Column, seed: int = 42) -> Column:
    """A number from 0 to 999,999 that key and seed fix."""
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed)), F.lit(1_000_000))


def numbered(df: DataFrame, order: Column, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with __at: each row's place from 1 by (``order``, ``key``) within each value of ``by``.

    Rows are numbered inside ranges of ``order``, after the sizes of the ranges before; only the table of these sizes is ordered as a whole.
    """
    df = df.withColumn("__draw", order)
    lo, hi = df.agg(F.min("__draw").cast("double"), F.max("__draw").cast("double")).first()
    step = (hi - lo) / RANGES if lo is not None and hi > lo else 1.0
    df = df.withColumn("__range", F.coalesce(F.floor((F.col("__draw").cast("double") - F.lit(lo or 0.0)) / step), F.lit(-1)))  # nulls come first
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy(*by, "__range").agg(F.count("*").alias("__size")).withColumn("__first", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    on = [*by, "__range"]
    starts = first.select("__first", *[F.col(c).alias(f"__of_{c}") for c in on])
    inside = F.row_number().over(Window.partitionBy(*on).orderBy("__draw", key))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on])
    out = df.withColumn("__in", inside).join(starts, same)
    return out.withColumn("__at", F.col("__first") + F.col("__in")).drop("__draw", "__range", "__in", "__first", *[f"__of_{c}" for c in on])


def group_split(df: DataFrame, group_col: str, shares: Sequence[tuple[str, float]] = (("train", 0.7), ("dev", 0.2), ("test", 0.1)), seed: int = 42, draw: Column | None = None, scale: int = 1_000_000) -> DataFrame:
    """``df`` with split; all rows of a group share one. ``draw`` is a number from 0 to ``scale`` - 1. No shuffle."""
    draw = drawn(group_col, seed) if draw is None else draw
    out, upto = F.lit(shares[-1][0]), sum(s for _, s in shares[:-1])
    for name, share in reversed(shares[:-1]):
        out = F.when(draw < round(upto * scale), name).otherwise(out)
        upto -= share
    return df.withColumn("split", out)


def no_leak(df: DataFrame, group_col: str, split_col: str = "split") -> DataFrame:
    """``df`` itself; ValueError if a group is in two splits."""
    none_left(df.groupBy(group_col).agg(F.count_distinct(split_col).alias("n")).where("n > 1"), "groups in more than one split")
    return df


def k_folds(df: DataFrame, k: int, by: Sequence[str] = (), key: str = "id", seed: int = 42, draw: Column | None = None) -> DataFrame:
    """``df`` with fold from 0 to k - 1, of sizes at most one apart within each value of ``by``."""
    return numbered(df, drawn(key, seed) if draw is None else draw, key, by).withColumn("fold", ((F.col("__at") - 1) % k).cast("int")).drop("__at")


def grouped_folds(df: DataFrame, group_col: str, k: int = 5, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """``df`` with fold; groups are dealt in turn, so folds differ by at most one group, and a group stays whole."""
    groups = df.select(group_col).distinct()
    return df.join(k_folds(groups, k, key=group_col, seed=seed, draw=draw), group_col)


def task_folds(df: DataFrame, categories: Sequence[str], k: int = 5, category_col: str = "keyword_category", split_col: str = "split", key: str = "id", seed: int = 42, draw: Column | None = None) -> DataFrame:
    """The rows of a task's categories for each of ``k`` runs (column run): all test rows, the dev rows of one fold, the train rows of the others.

    Folds are drawn within each category and split, whatever the task, so that tasks share them.
    """
    folds = k_folds(df, k, [category_col, split_col], key, seed, draw).where(F.col(category_col).isin(list(categories)))
    runs = folds.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    same, split = F.col("fold") == F.col("run"), F.col(split_col)
    return runs.where((split == "test") | ((split == "train") & ~same) | ((split == "dev") & same)).drop("fold")


def first_rows(df: DataFrame, order: Column, key: str, by: Sequence[str], size: Column) -> DataFrame:
    """The first ``size`` rows by (``order``, ``key``) of each value of ``by``.

    Counts per range of the order tell which ranges are taken whole and which one is cut; only the rows of that one are shuffled and numbered.
    ``size`` is the same in all rows of a value of ``by``.
    """
    df = df.withColumns({"__draw": order, "__size": size})
    lo, hi = df.agg(F.min("__draw").cast("double"), F.max("__draw").cast("double")).first()
    step = (hi - lo) / RANGES if lo is not None and hi > lo else 1.0
    df = df.withColumn("__range", F.coalesce(F.floor((F.col("__draw").cast("double") - F.lit(lo or 0.0)) / step), F.lit(-1)))  # nulls come first
    upto = Window.partitionBy(*by).orderBy("__range")
    counts = df.groupBy(*by, "__range").agg(F.count("*").alias("__n"), F.max("__size").alias("__size")).withColumn("__upto", F.sum("__n").over(upto))
    cut = counts.groupBy(*by).agg(
        F.min(F.when(F.col("__upto") > F.col("__size"), F.col("__range"))).alias("__cut"),
        F.max(F.when(F.col("__upto") <= F.col("__size"), F.col("__upto"))).alias("__whole"),
    ).withColumnsRenamed({c: f"__of_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.lit(True))
    near = df.join(F.broadcast(cut), same)  # a row per value of ``by``
    kept = near.where(F.col("__cut").isNull() | (F.col("__range") < F.col("__cut")))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy("__draw", key))
    edge = near.where(F.col("__range") == F.col("__cut")).withColumn("__at", inside).where(F.col("__at") + F.coalesce("__whole", F.lit(0)) <= F.col("__size")).drop("__at")
    return kept.unionByName(edge).drop("__draw", "__size", "__range", "__cut", "__whole", *[f"__of_{c}" for c in by])


def resamples(df: DataFrame, key: str, iterations: int, share: float, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """One set of rows per iteration, each floor(share * rows) of them without replacement; column iteration."""
    n = df.count()
    many = df.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = drawn(F.concat_ws("|", F.col(key), F.col("iteration")), seed) if draw is None else draw
    return first_rows(many, order, key, ["iteration"], F.lit(int(n * share)))


def learning_curve(df: DataFrame, key: str, label_col: str, percents: Sequence[float] | int, iterations: int = 3, seed: int = 42, draw: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Row sets of growing size with at least one row per class: columns percent, iteration and size; within each value of ``by``, if given.

    ``percents`` lists shares of 100 (100 is added), or is a number of equal steps. The whole set comes once.
    """
    steps = [100.0 * (i + 1) / percents for i in range(percents)] if isinstance(percents, int) else sorted({*map(float, percents), 100.0})
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"), F.count_distinct(label_col).alias("__k"))  # a row per value of ``by``
    if by:
        df = df.join(F.broadcast(sizes), [*by])
    else:
        n, classes = sizes.first()
        df = df.withColumns({"__n": F.lit(n), "__k": F.lit(classes)})
    size = lambda p: F.greatest(F.floor(F.col("__n") * p / 100), F.col("__k")) if p < 100 else F.col("__n")
    each = F.array(*[F.struct(F.lit(p).alias("percent"), F.lit(i).alias("iteration"), size(p).cast("long").alias("size")) for p in steps for i in range(iterations if p < 100 else 1)])
    many = df.withColumn("__set", F.explode(each)).select(*df.columns, "__set.*").drop("__n")
    order = drawn(F.concat_ws("|", F.col(key), F.col("percent"), F.col("iteration"), *[F.col(c) for c in by]), seed) if draw is None else draw
    many = numbered(many, order, key, [*by, "percent", "iteration", label_col]).withColumn("__later", F.col("__at") > 1).drop("__at")
    placed = numbered(many, order, key, [*by, "percent", "iteration", "__later"])
    before = F.when(F.col("__later"), F.col("__k")).otherwise(0)  # each class's first row comes before all others
    return placed.where(F.col("__at") + before <= F.col("size")).drop("__at", "__later", "__k")


def constrained_resample(df: DataFrame, key: str, label_col: str, test_share: float = 0.2, min_train: int = 1, min_test: int = 1, seed: int = 42, draw: Column | None = None, most_exact: int = 1_000_000) -> DataFrame:
    """``df`` with part train or test: each class has at least ``min_train`` and ``min_test`` rows in them; ValueError if one can't.

    The test part has round(test_share * rows) rows at every size, unless the minimums ask for others. ``most_exact`` has no effect any more.
    """
    classes = df.groupBy(label_col).count()
    none_left(classes.where(F.col("count") < min_train + min_test), "classes with too few rows")
    n, k = classes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    order = drawn(key, seed) if draw is None else draw
    at = F.col("__at")
    ranked = numbered(df, order, key, [label_col]).withColumn("__tier", F.when(at <= min_test, 0).when(at <= min_test + min_train, 2).otherwise(1)).drop("__at")
    free = max(round(n * test_share), 0) - k * min_test  # rows of tier 1 that go to test
    test = (F.col("__tier") == 0) | ((F.col("__tier") == 1) & (at <= free))
    return numbered(ranked, order, key, ["__tier"]).withColumn("part", F.when(test, "test").otherwise("train")).drop("__tier", "__at")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """``n`` rows, the first by the drawn number."""
    return df.orderBy(drawn(key, seed) if draw is None else draw, key).limit(n)


def cap_per_keyword(df: DataFrame, n: int, key: str, keyword_col: str = "keyword", seed: int = 42, draw: Column | None = None) -> DataFrame:
    """At most ``n`` rows per keyword, the first by the drawn number."""
    order = Window.partitionBy(keyword_col).orderBy(drawn(key, seed) if draw is None else draw, key)
    return df.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= n).drop("__at")


def sample_blocks(df: DataFrame, order_col: str, block_size: int, block_share: float, row_share: float, seed: int = 42, block_draw: Column | None = None, row_draw: Column | None = None) -> DataFrame:
    """Whole blocks of ``block_size`` rows by position kept with a chance, then an exact share of the rows of each kept block; column block."""
    df = df.withColumn("block", F.floor(F.col(order_col) / block_size))
    keep = (drawn("block", seed) if block_draw is None else block_draw) < int(block_share * 1_000_000)
    df = df.where(keep)
    order = Window.partitionBy("block").orderBy(drawn(order_col, seed) if row_draw is None else row_draw, order_col)
    size = F.count("*").over(Window.partitionBy("block"))
    return df.withColumn("__at", F.row_number().over(order)).withColumn("__n", size).where(F.col("__at") <= F.round(F.col("__n") * row_share)).drop("__at", "__n")
