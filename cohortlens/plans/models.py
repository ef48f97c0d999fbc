"""Queries on features, models, evaluation, comparison and the domain study."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import text as tx
from cohortlens.operators import compare as cp
from cohortlens.operators import domain as dm
from cohortlens.operators import features as ft
from cohortlens.operators import metrics as mt
from cohortlens.operators import models as md
from cohortlens.operators import splits as sp
from cohortlens.operators import stages as sg
from cohortlens.operators.splits import k_folds
from cohortlens.operators.tokens import vocabulary
from cohortlens.plans.common import LABELLED, draw, draw_sql, labelled, table
from cohortlens.sources.shared import shared_dir, stored


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("doc_id", "y", "lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))


def _counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = stored(_tokens(spark, d), "tokens")  # read for the vocabulary, the weights and the counts
    v = ft.sent(vocabulary(t.where("doc_id % 5 > 0"), rm_top=0, min_freq=20, stopwords=["the"]).select("token"), "token")
    return t, ft.count_features(t.repartition("doc_id"), "doc_id", "tokens", v)  # whole lists are moved; what follows by row stays where it is


def _idf(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, counts = _counts(spark, d)
    train = counts.where("row_id % 5 > 0")
    return t, counts, ft.sent(ft.idf(train, t.where("doc_id % 5 > 0").count()), "feature")


def target_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    return ft.encode_targets(rows.select("doc_id", "y"), "y", ft.target_encoding(rows, "y"))


def onehot(spark: SparkSession, d: str) -> DataFrame:
    return ft.one_hot(labelled(spark, d).select("doc_id", "source"), "doc_id", "source", "source", F.col("doc_id") % 40 < 5)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)[1]


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    _, counts, weights = _idf(spark, d)
    return ft.tfidf(counts, weights).withColumn("value", F.round("value", 6))


def interaction(spark: SparkSession, d: str) -> DataFrame:
    t, counts = _counts(spark, d)
    return ft.interactions(ft.one_hot(t, "doc_id", "lang", "lang"), counts, "lang x tokens")


def interaction_tfidf(spark: SparkSession, d: str) -> DataFrame:
    t, counts = _counts(spark, d)
    both = ft.interactions(ft.one_hot(t, "doc_id", "lang", "lang"), counts, "lang x tokens")
    weights = ft.sent(ft.idf(both.where("row_id % 5 > 0"), t.where("doc_id % 5 > 0").count()), "feature")
    return ft.tfidf(both, weights).withColumn("value", F.round("value", 6))


def represented(spark: SparkSession, d: str) -> DataFrame:
    t, counts = _counts(spark, d)
    names = ["lang", "tokens"]
    whole = ft.represent({"lang": ft.one_hot(t, "doc_id", "lang", "lang"), "tokens": counts}, names)
    return ft.feature_index(whole, names)


def standardize(spark: SparkSession, d: str) -> DataFrame:
    out = ft.standardize(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.lit(3.0).alias("same")), ["size", "same"], F.col("p_partkey") % 2 == 0)
    return out.withColumn("size", F.round("size", 6))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return ft.class_weights(labelled(spark, d), "y", "lang").withColumn("weight", F.round("weight", 6))


def task_weights(spark: SparkSession, d: str) -> DataFrame:
    return ft.task_weights(table(spark, d, "documents"), "lang").withColumn("weight", F.round("weight", 6))


def feature_crosses(spark: SparkSession, d: str) -> DataFrame:
    return ft.crosses(labelled(spark, d).select("doc_id", "lang", "quality", "toxic"), "doc_id", ["lang", "quality", "toxic"]).groupBy("component", "feature").agg(F.sum("value").alias("n"))


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return ft.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("row_id", F.posexplode("vector").alias("d", "x")).withColumn("x", F.round("x", 5))


def prior(spark: SparkSession, d: str) -> DataFrame:
    return md.prior(labelled(spark, d), "y").withColumn("p", F.round("p", 6))


def most_frequent(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    return rows.select("doc_id", F.lit(md.most_frequent(rows, "y")).alias("predicted_label"))


def conditional_majority(spark: SparkSession, d: str) -> DataFrame:
    held = md.ConditionalMajority(1.0).fit(labelled(spark, d).where("doc_id % 40 < 30"), "source", "y")
    return md.probability_columns(held.predict(labelled(spark, d).select("doc_id", "source")), [f"p{y}" for y in held.labels]).withColumns({f"p{y}": F.round(f"p{y}", 6) for y in held.labels})


#: Hard predictions that SQL repeats: a formula of the id in place of a model.
_HARD = "case when doc_id % 4 = 0 then (doc_id % 3)::int else y end"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select("doc_id", "y", "lang", "source", "n_chars")
    hard = F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 3).cast("int")).otherwise(F.col("y"))
    return rows.withColumn("p", hard).withColumn("fold", (F.col("doc_id") % 5).cast("int"))


_PRED = f"{LABELLED}, pred as (select doc_id, y, lang, source, n_chars, {_HARD} as p, (doc_id % 5)::int as fold from labelled)"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return mt.scores(_predicted(spark, d), "y", "p", ["lang"]).withColumn("score", F.round("score", 6))


def per_class(spark: SparkSession, d: str) -> DataFrame:
    out = mt.per_class(_predicted(spark, d), "y", "p")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d)
    return mt.confusion(rows, "y", "p", rows.select(F.col("y").alias("label")), ["fold"])


def roc(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).withColumn("s", F.round(F.col("n_chars") / 200))
    return mt.roc_curve(rows, F.col("y") == 2, "s", ["lang"]).drop("neg", "pos").withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


def roc_thinned(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).withColumn("s", F.round(F.col("n_chars") / 200))
    return mt.thinned(mt.roc_curve(rows, F.col("y") == 2, "s", ["lang"]), ["lang"]).select("lang", "threshold", "fp", "tp")


def auc(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).withColumn("s", F.round(F.col("n_chars") / 200))
    return mt.auc(mt.roc_curve(rows, F.col("y") == 2, "s", ["lang"]), ["lang"]).withColumn("auc", F.round("auc", 6))


def group_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d)
    out = mt.group_scores(rows, "y", "p", ["lang", "source"], rows.select(F.col("y").alias("label")))
    balance = F.array_join(F.transform(F.map_entries("class_balance"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("group_category", "group_subcategory", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "precision", "recall")], "support", balance.alias("class_balance"))


def errors(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "documents").select("doc_id", F.col("text").alias("note_text"))
    return mt.errors(_predicted(spark, d).select("doc_id", "y", "p", "fold"), "y", "p", "doc_id", source)


def _fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two stand-in models per language and fold."""
    rows = _predicted(spark, d).withColumn("identifier", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = rows.withColumn("p", F.when((F.col("identifier") == "b") & (F.col("doc_id") % 7 == 0), F.lit(0)).otherwise(F.col("p")))
    s = mt.scores(rows, "y", "p", ["identifier", "lang", "fold"])
    return s.withColumnRenamed("lang", "keyword_category").withColumn("split", F.lit("dev"))


_FOLDS = f"""{_PRED}, two as (select * exclude (p), case when identifier = 'b' and doc_id % 7 = 0 then 0 else p end as p from pred, (select unnest(['a', 'b']) as identifier)),
  side as (select identifier, lang, fold, y as label, 1 as t, 0 as q, (y = p)::int as h from two union all select identifier, lang, fold, p, 0, 1, 0 from two),
  cls as (select identifier, lang, fold, label, sum(t) as t, sum(q) as q, sum(h) as h from side group by all),
  fs as (select identifier, lang as keyword_category, fold, 'dev' as split, sum(h) / sum(t) as accuracy, avg(case when q > 0 then h / q else 0 end) as macro_precision, avg(case when t > 0 then h / t else 0 end) as macro_recall, avg(2 * h / (t + q)) as macro_f1, sum(h) / sum(q) as micro_precision, sum(h) / sum(t) as micro_recall, 2 * sum(h) / (sum(t) + sum(q)) as micro_f1 from cls group by all),
  fold_scores as (select identifier, keyword_category, fold, split, unnest(['accuracy', 'macro_precision', 'macro_recall', 'macro_f1', 'micro_precision', 'micro_recall', 'micro_f1']) as metric, unnest([accuracy, macro_precision, macro_recall, macro_f1, micro_precision, micro_recall, micro_f1])::double as score from fs)"""


def std_error(spark: SparkSession, d: str) -> DataFrame:
    return mt.mean_and_error(_fold_scores(spark, d), "score", ["identifier", "keyword_category", "metric"]).withColumns({c: F.round(c, 6) for c in ("mean", "std_error")})


def flatten_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d)
    out = cp.flatten_scores(mt.scores(rows, "y", "p", ["fold"]).where("metric like 'macro%' or metric = 'accuracy'"), mt.per_class(rows, "y", "p", ["fold"]), ["fold"])
    return out.withColumn("score", F.round("score", 6))


def confusion_norm(spark: SparkSession, d: str) -> DataFrame:
    return cp.normalised_confusion(mt.confusion(_predicted(spark, d), "y", "p", by=["fold"])).withColumn("share", F.round("share", 6))


def confusion_to_scores(spark: SparkSession, d: str) -> DataFrame:
    out = cp.confusion_scores(mt.confusion(_predicted(spark, d), "y", "p", by=["lang"]), ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


#: The languages of the documents, the categories of the stand-in scores.
LANGS = ("de", "en", "es", "fr")


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).groupBy("fold", F.col("lang").alias("identifier"), F.col("y").cast("string").alias("class")).agg(F.avg((F.col("y") == F.col("p")).cast("int")).alias("score"), F.count("*").alias("support"))
    return cp.class_scores(rows.withColumn("metric", F.lit("recall"))).withColumns({c: F.round(c, 6) for c in ("mean", "std", "std_error")})


def task_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select("doc_id", F.col("lang").alias("keyword_category"), F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "dev").otherwise("test").alias("split"))
    return sp.task_folds(rows, ["en", "fr"], 3, key="doc_id", draw=draw("doc_id"))


def summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = cp.summary(_fold_scores(spark, d), LANGS)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c[:2] in LANGS})


def paired_ttest(spark: SparkSession, d: str) -> DataFrame:
    return cp.paired_t_tests(_fold_scores(spark, d), 5).withColumn("p_value", F.round("p_value", 6))


def label_bias(spark: SparkSession, d: str) -> DataFrame:
    return cp.label_bias(labelled(spark, d), "lang", "source", "y").withColumn("share", F.round("share", 6))


def distribution_facets(spark: SparkSession, d: str) -> DataFrame:
    return dm.distribution(labelled(spark, d), ["lang", "quality", "source"], "toxic").withColumn("share", F.round("share", 6))


def learning_curve_table(spark: SparkSession, d: str) -> DataFrame:
    s = _fold_scores(spark, d).withColumns({"learning_curve_train_proportion": F.lit(50.0), "learning_curve_train_size": 100 + 3 * F.col("fold")})
    return cp.learning_curve_table(s, ["identifier", "metric"]).withColumns({c: F.round(c, 6) for c in ("mean", "std_error")})


def metric_table(spark: SparkSession, d: str) -> DataFrame:
    s = _fold_scores(spark, d).withColumn("learning_curve_train_proportion", F.when(F.col("fold") < 4, 100.0).otherwise(50.0))
    return cp.metric_table(s, ["identifier", "metric"]).withColumns({c: F.round(c, 6) for c in ("mean", "std_error")})


def group_table(spark: SparkSession, d: str) -> DataFrame:
    s = mt.union_all([mt.group_scores(_predicted(spark, d).where(f"fold = {f}"), "y", "p", ["lang"]) for f in range(5)])
    out = cp.group_table(s.withColumns({"model_type": F.lit("m"), "split": F.lit("dev")}))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1", "precision", "recall")})


def topk_coefficients(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("feature"), F.col("l_quantity").cast("double").alias("coefficient"))
    return cp.coefficient_table(li, 5)[1].select("label", "feature", F.round("mean", 6).alias("mean"), F.round("std_error", 6).alias("std_error"), "place")


def task_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).withColumn("p_true", (1 + F.col("doc_id") % 9) / 10)
    return mt.task_loss(rows, "lang", "p_true", F.lit(2.0)).withColumn("loss", F.round("loss", 6))


def available_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("keyword_category"), F.col("o_orderstatus").alias("split"))
    return cp.available_splits(rows).withColumn("splits", F.array_join("splits", ","))


def summary_display(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("m", "x", "b", 0), ("m", "x", "a", 1)], "model_type string, feature_set string, identifier string, ord int")
    out = cp.display(cp.summary(_fold_scores(spark, d), LANGS), names)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c[:2] in LANGS})


# ---- models that are fitted -----------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") % 3).cast("int"))
    return e.select("vec_id", "y", F.col("y").cast("double").alias("label_idx"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), "embedding", F.col("label").alias("label"))


def logreg_predict(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    model = md.logistic(rows.where("vec_id % 5 > 0"), 1.0)
    return md.probability_columns(md.predict_vectors(model, rows.where("vec_id % 5 = 0"), [0, 1, 2]), ["0", "1", "2"]).drop("features", "embedding")


def logreg_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).withColumn("part", F.col("vec_id") % 5)
    _, best, found = md.logistic_grid(rows.where("part <> 1"), rows.where("part = 1"), [0, 1, 2], "y")
    return spark.createDataFrame([(c, s, c == best) for c, s in found], "c double, macro_f1 double, chosen boolean")


def rf_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).withColumn("part", F.col("vec_id") % 5)
    model, best, found = md.forest_grid(rows.where("part <> 1"), rows.where("part = 1"), [0, 1, 2], "y")
    return md.importances(spark, model, [f"v{i}" for i in range(model.numFeatures)]).withColumn("min_split", F.lit(best[1]))


def rf_constrained(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of each setting over two constrained draws."""
    _, best, found = md.constrained_forest(_vectors(spark, d), "vec_id", "y", [0, 1, 2], draws=2, refit=False)
    return spark.createDataFrame([(depth, least, score, (depth, least) == best) for (depth, least), score in found], "max_depth int, min_split int, macro_f1 double, chosen boolean")


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    model = md.logistic(rows, 0.3)
    return md.coefficients(spark, model, [f"v{i}" for i in range(model.numFeatures)], ["0", "1", "2"])


def batch_scoring(spark: SparkSession, d: str) -> DataFrame:
    def make():  # a stand-in for a network: softmax over three sums
        import numpy as np

        def run(x):
            z = np.stack([x[:, k::3].sum(axis=1) for k in range(3)], axis=1)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return run

    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = md.score_batches(rows, make, "x", 64, "array<double>", "probabilities", 64)
    return md.with_argmax(out.drop("x"), ["a", "b", "c"])


def batch_embedding(spark: SparkSession, d: str) -> DataFrame:
    def make():  # a stand-in for an encoder: lengths of the words' hashed buckets
        import numpy as np

        return lambda x: np.tanh(x[:, :8]).astype("float32")

    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return md.score_batches(rows, make, "x", 64, "array<float>", "vector", 128).drop("x")


def apply_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The apply job on all documents: features and model of four fifths of the labelled ones are saved and loaded; probabilities and the likeliest label; y is null without a label."""
    labels = table(spark, d, "labels").select("doc_id", (2 * F.col("quality") + F.col("toxic")).cast("int").alias("y"))
    docs, tokens = table(spark, d, "documents").select("doc_id", "text"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    train = stored(docs.join(labels.where("doc_id % 5 > 0"), "doc_id").select("doc_id", tokens.alias("tokens"), F.col("y").cast("double").alias("label_idx")), "train")
    stage = sg.FeatureStage(components=json.dumps([{"name": "tokens", "column": "tokens", "kind": "tfidf", "rm_top": 0, "min_freq": 20, "stopwords": ["the"]}]), representation=["tokens"])
    model = sg.fit_task(train, stage)
    path = f"{shared_dir(spark)}/task-{uuid.uuid4().hex}"
    sg.save_task(spark, model, path, [str(k) for k in range(model.stages[-1].numClasses)])
    scored = sg.apply_saved(docs.select("doc_id", tokens.alias("tokens")), path, as_columns=False).drop("tokens")  # texts stay where they are
    return scored.join(labels, "doc_id", "left").select("doc_id", "y", F.col("y").cast("double").alias("label_idx"), "probabilities", F.col("predicted_label").cast("int").alias("predicted_label"))


def model_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = k_folds(labelled(spark, d).select("doc_id", "y", "lang", "source"), 3, ["lang"], "doc_id").withColumnsRenamed({"lang": "keyword_category", "y": "label"})
    fits = {
        "majority": lambda train, dev: dev.withColumn("predicted_label", F.lit(md.most_frequent(train, "label"))),
        "conditional": lambda train, dev: md.ConditionalMajority().fit(train, "source", "label").predict(dev),
    }
    categories = [r.keyword_category for r in rows.select("keyword_category").distinct().orderBy("keyword_category").collect()]  # a row per language
    return md.sweep(rows, categories, range(3), fits)


def logistic_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Counts of words and one-hots of the source, by language: strengths, folds and a step of half the rows."""
    rows = labelled(spark, d).select(F.col("doc_id").alias("row_id"), F.col("y").alias("label"), F.col("lang").alias("keyword_category"), "source", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    made = _word_vectors(stored(rows, "sweep-words"), {"words": "tokens"})
    stage = sg.FeatureStage(components=json.dumps([{"name": "source", "column": "source", "kind": "binary"}]), representation=["source"], outputCol="origin")
    made = stage.fit(made).transform(made).select("row_id", "label", "keyword_category", "words", "origin")
    folds = stored(k_folds(made, 3, ["keyword_category"], "row_id"), "sweep-rows")
    return md.logistic_sweep(folds, ["words", "origin"], grid=(0.3, 3.0), percents=[50])[0]


def _word_vectors(rows: DataFrame, columns: dict[str, str], least: int = 20) -> DataFrame:
    """``rows`` with a vector of length 1 of word counts for each column of tokens; vocabularies are learned side by side."""

    def learned(what: tuple[str, str]) -> sg.FeatureStageModel:
        out, col = what
        model = sg.FeatureStage(components=json.dumps([{"name": out, "column": col, "kind": "counts", "rm_top": 0, "min_freq": least, "stopwords": ["the"]}]), representation=[out], outputCol=f"{out} counts").fit(rows)
        model.transform(rows)  # sends its terms, one by one
        return model

    with ThreadPoolExecutor(max(1, len(columns))) as pool:
        models = list(pool.map(learned, columns.items()))
    made = rows
    for (out, col), model in zip(columns.items(), models, strict=True):
        made = Normalizer(p=2.0, inputCol=f"{out} counts", outputCol=out).transform(model.transform(made)).drop(f"{out} counts", col)
    return made


def _discriminated(spark: SparkSession, d: str) -> DataFrame:
    """Ten discriminators of a document's toxicity: its commonest value; source, quality and language alone; their pairs and triple; words, and words of its neutral text."""
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    rows = labelled(spark, d).select(F.col("doc_id").alias("row_id"), F.floor(F.col("doc_id") / 3).alias("group"), "toxic", "source", "quality", "lang", words("text").alias("plain"), words(tx.swap_identifiers("text")).alias("neutral"))
    rows = _word_vectors(stored(rows, "discriminated-words"), {"words": "plain", "words_neutral": "neutral"})  # read for each vocabulary and for the vectors
    given = ["source", "quality", "lang"]
    crosses = [c for k in (2, 3) for c in combinations(given, k)]
    return dm.discriminate(rows, "group", "toxic", given, ["words", "words_neutral"], 5, draw=draw("group"), crosses=crosses)


def domain_discrimination(spark: SparkSession, d: str) -> DataFrame:
    f1, table_, _ = dm.discrimination_scores(stored(_discriminated(spark, d), "discriminators"))
    tests = cp.paired_t_tests(f1.withColumn("split", F.lit("all")), 5, ["split"], "discriminator").where("b = 'most_frequent'").select(F.col("a").alias("discriminator"), "p_value")
    return table_.join(tests, "discriminator")


def domain_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of each discriminator, summed over its folds."""
    return dm.discrimination_scores(stored(_discriminated(spark, d), "discriminators"))[2]


def domain_majorities(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).select(F.col("doc_id").alias("row_id"), "source", "y", "lang")
    return dm.discriminate(rows, "source", "y", ["lang"], (), 4, draw=F.length("source") * 1000 + F.ascii(F.substring("source", -1, 1)))


def special_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(spark, d).withColumn("row_id", F.col("doc_id"))
    long = rows.select("row_id", F.col("y").alias("y_true"), F.explode(F.array(F.struct(F.lit("base").alias("discriminator"), F.col("p").alias("y_pred")), F.struct(F.lit("neutral").alias("discriminator"), F.when(F.col("doc_id") % 8 == 0, F.col("y")).otherwise(0).alias("y_pred")))).alias("x")).select("row_id", "y_true", "x.*")
    return dm.special_cases(long, "base", "neutral")


def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    return dm.project(table(spark, d, "embeddings").withColumn("keyword", F.col("label")), "vec_id", "embedding", ["label"], {"low": [0, 1, 2], "none": [99]})


_COUNTS = "t as (select doc_id, y, lang, regexp_extract_all(lower(text), '[a-z]+') as tokens from labelled), f as (select doc_id, unnest(tokens) as token from t), v as (select token from f where doc_id % 5 > 0 group by 1 having count(*) >= 20 and token <> 'the'), counts as (select doc_id as row_id, 'tokens' as component, token as feature, count(*)::double as value from f semi join v using (token) group by all)"
_CLS = "side as (select {0} y as label, 1 as t, 0 as q, (y = p)::int as h from pred union all select {0} p, 0, 1, 0 from pred), cls as (select {0} label, sum(t)::bigint as support, sum(q)::bigint as predicted, sum(h)::bigint as correct from side group by all), pc as (select *, round(case when predicted > 0 then correct / predicted else 0 end, 6)::double as precision, round(case when support > 0 then correct / support else 0 end, 6)::double as recall, round(2 * correct / (support + predicted), 6)::double as f1 from cls)"
_ROC = "c as (select lang, round(n_chars / 200)::double as threshold, count(*) filter (y = 2) as p, count(*) filter (y <> 2) as n from pred group by 1, 2), r as (select lang, threshold, (sum(n) over u)::bigint as fp, (sum(p) over u)::bigint as tp, (sum(n) over a)::bigint as n_neg, (sum(p) over a)::bigint as n_pos from c window u as (partition by lang order by threshold desc), a as (partition by lang))"
_GROUPS = "g as (select y, p, unnest(['lang', 'source']) as group_category, unnest([lang, source]) as group_subcategory from pred), h as (select * from g union all select y, p, group_category, 'overall' from g), side as (select group_category, group_subcategory, y as label, 1 as t, 0 as q, (y = p)::int as h from h union all select group_category, group_subcategory, p, 0, 1, 0 from h), cls as (select group_category, group_subcategory, label, sum(t) as t, sum(q) as q, sum(h) as h from side group by all)"

SQL = {
    "target_encoding": f"with {LABELLED}, c as (select y, row_number() over (order by count(*), y) - 1 as k from labelled group by y) select doc_id, y, k::int as label_idx from labelled join c using (y)",
    "onehot": f"with {LABELLED} select doc_id as row_id, 'source' as component, source as feature, 1.0::double as value from labelled where source in (select source from labelled where doc_id % 40 < 5)",
    "token_counts": f"with {LABELLED}, {_COUNTS} select * from counts",
    "tfidf": f"with {LABELLED}, {_COUNTS}, w as (select feature, ln((1 + (select count(*) from t where doc_id % 5 > 0)) / (1.0 + count(distinct row_id))) + 1 as idf from counts where row_id % 5 > 0 group by 1) select row_id, component, feature, round(value * idf / sqrt(sum(value * idf * value * idf) over (partition by row_id)), 6) as value from counts join w using (feature)",
    "interaction": f"with {LABELLED}, {_COUNTS} select row_id, 'lang x tokens' as component, '(lang=' || lang || ')x(tokens=' || feature || ')' as feature, value from counts join t on doc_id = row_id",
    "represented": f"with {LABELLED}, {_COUNTS}, a as (select 0 as k, 'lang' as component, lang as feature from t union select 1, component, feature from counts) select component, feature, (row_number() over (order by k, feature) - 1)::int as index from a",
    "standardize": "with s as (select avg(p_size) as m, stddev_pop(p_size) as sd from part where p_partkey % 2 = 0) select p_partkey, round((p_size - m) / sd, 6) as size, 0.0::double as same from part, s",
    "class_weights": f"with {LABELLED}, c as (select lang as task, y as label, count(*) as n from labelled group by all) select task, label, n, round((sum(n) over (partition by task)) / ((count(*) over (partition by task)) * n), 6)::double as weight from c",
    "task_weights": "select lang as task, count(*) as n, round((sum(count(*)) over ()) / count(*), 6)::double as weight from documents group by lang",
    "feature_crosses": f"with {LABELLED}, x as (select unnest(['lang', 'quality', 'toxic', 'lang&quality', 'lang&toxic', 'quality&toxic', 'lang&quality&toxic']) as component, unnest([lang, quality::varchar, toxic::varchar, concat_ws('&', lang, quality), concat_ws('&', lang, toxic), concat_ws('&', quality, toxic), concat_ws('&', lang, quality, toxic)]) as feature from labelled) select component, feature, count(*)::double as n from x group by all",
    "mean_pool": "select label as row_id, (i - 1)::int as d, round(avg(embedding[i]::double), 5) as x from embeddings, generate_series(1, 64) g(i) group by 1, 2",
    "prior": f"with {LABELLED} select y as label, round(count(*) / sum(count(*)) over (), 6)::double as p from labelled group by y",
    "most_frequent": f"with {LABELLED} select doc_id, (select y from labelled group by y order by count(*) desc, y limit 1) as predicted_label from labelled",
    "conditional_majority": f"with {LABELLED}, n as (select source, count(*) as n, {', '.join(f'count(*) filter (y = {k}) as n{k}' for k in range(4))} from labelled where doc_id % 40 < 30 group by source), q as (select doc_id, l.source, {', '.join(f'round(coalesce((n{k} + 1) / (n + 4), 0.25), 6)::double as p{k}' for k in range(4))} from labelled l left join n on n.source = l.source) select *, case when p0 >= greatest(p1, p2, p3) then 0 when p1 >= greatest(p2, p3) then 1 when p2 >= p3 then 2 else 3 end as predicted_label from q",
    "metrics": f"with {_PRED}, side as (select lang, y as label, 1 as t, 0 as q, (y = p)::int as h from pred union all select lang, p, 0, 1, 0 from pred), cls as (select lang, label, sum(t) as t, sum(q) as q, sum(h) as h from side group by all), m as (select lang, sum(h) / sum(t) as a, avg(case when q > 0 then h / q else 0 end) as b, avg(case when t > 0 then h / t else 0 end) as c, avg(2 * h / (t + q)) as e, sum(h) / sum(q) as g from cls group by 1) select lang, unnest(['accuracy', 'macro_precision', 'macro_recall', 'macro_f1', 'micro_precision', 'micro_recall', 'micro_f1']) as metric, round(unnest([a, b, c, e, g, a, a])::double, 6) as score from m",
    "per_class": f"with {_PRED}, {_CLS.format('')} select * from pc",
    "confusion": f"with {_PRED}, k as (select distinct y from labelled), g as (select fold, a.y as y_true, b.y as y_pred from (select distinct fold from pred), k a, k b) select g.fold, y_true, y_pred, count(doc_id) as n from g left join pred on pred.fold = g.fold and pred.y = y_true and pred.p = y_pred group by all",
    "roc": f"with {_PRED}, {_ROC} select *, round(fp / nullif(n_neg, 0), 6)::double as fpr, round(tp / nullif(n_pos, 0), 6)::double as tpr from r",
    "roc_thinned": f"with {_PRED}, {_ROC}, s as (select *, fp - coalesce(lag(fp) over w, 0) as a, tp - coalesce(lag(tp) over w, 0) as b, lead(fp) over w - fp as c, lead(tp) over w - tp as e from r window w as (partition by lang order by threshold desc)) select lang, threshold, fp, tp from s where not coalesce(a * e = c * b, false)",
    "auc": f"with {_PRED}, {_ROC}, s as (select *, (fp - coalesce(lag(fp) over w, 0)) * (tp + coalesce(lag(tp) over w, 0)) / 2 as area from r window w as (partition by lang order by threshold desc)) select lang, round(sum(area) / nullif(max(n_neg)::double * max(n_pos), 0), 6) as auc from s group by 1",
    "group_scores": f"with {_PRED}, {_GROUPS}, m as (select group_category, group_subcategory, round(sum(h) / sum(t), 6)::double as accuracy, round(avg(2 * h / (t + q)), 6)::double as f1, round(avg(case when q > 0 then h / q else 0 end), 6)::double as precision, round(avg(case when t > 0 then h / t else 0 end), 6)::double as recall, sum(t)::bigint as support, string_agg(label || ':' || t, ',' order by label) filter (t > 0) as class_balance from cls group by all) select * from m",
    "errors": f"with {_PRED} select pred.doc_id, y, p, fold, text as note_text from pred join documents using (doc_id) where y <> p",
    "std_error": f"with {_FOLDS} select identifier, keyword_category, metric, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 6) as std_error from fold_scores group by all",
    "flatten_scores": f"with {_PRED}, {_CLS.format('fold, ')}, raw as (select fold, sum(correct) / sum(support) as a, avg(case when predicted > 0 then correct / predicted else 0 end) as b, avg(case when support > 0 then correct / support else 0 end) as c, avg(2 * correct / (support + predicted)) as e from cls group by 1) select fold, unnest(['accuracy', 'precision', 'recall', 'f1']) as metric, null::varchar as class, round(unnest([a, b, c, e])::double, 6) as score, null::bigint as support from raw union all select fold, unnest(['precision', 'recall', 'f1']), label::varchar, unnest([precision, recall, f1]), support from pc",
    "confusion_norm": f"with {_PRED} select y as y_true, p as y_pred, count(*) as n, round(count(*) / sum(count(*)) over (partition by y), 6)::double as share from pred group by y, p",
    "confusion_to_scores": f"with {_PRED}, side as (select lang, y as label, 1 as t, 0 as q, (y = p)::int as h from pred union all select lang, p, 0, 1, 0 from pred), cls as (select lang, label, sum(t) as t, sum(q) as q, sum(h) as h from side group by all having sum(t) > 0) select lang, round(sum(h) / sum(t), 6)::double as accuracy, round(avg(case when q > 0 then h / q else 0 end), 6)::double as precision, round(avg(h / t), 6)::double as recall, round(avg(2 * h / (t + q)), 6)::double as f1 from cls group by 1",
    "summary_pivot": f"with {_FOLDS} select split, metric, identifier, round(avg(score) filter (keyword_category = 'de'), 6) as de_mean, round(stddev_samp(score) filter (keyword_category = 'de'), 6) as de_std, round(avg(score) filter (keyword_category = 'en'), 6) as en_mean, round(stddev_samp(score) filter (keyword_category = 'en'), 6) as en_std, round(avg(score) filter (keyword_category = 'es'), 6) as es_mean, round(stddev_samp(score) filter (keyword_category = 'es'), 6) as es_std, round(avg(score) filter (keyword_category = 'fr'), 6) as fr_mean, round(stddev_samp(score) filter (keyword_category = 'fr'), 6) as fr_std from fold_scores group by 1, 2, 3",
    "summary_display": f"with {_FOLDS} select split, metric, identifier, round(avg(score) filter (keyword_category = 'de'), 6) as de_mean, round(stddev_samp(score) filter (keyword_category = 'de'), 6) as de_std, round(avg(score) filter (keyword_category = 'en'), 6) as en_mean, round(stddev_samp(score) filter (keyword_category = 'en'), 6) as en_std, round(avg(score) filter (keyword_category = 'es'), 6) as es_mean, round(stddev_samp(score) filter (keyword_category = 'es'), 6) as es_std, round(avg(score) filter (keyword_category = 'fr'), 6) as fr_mean, round(stddev_samp(score) filter (keyword_category = 'fr'), 6) as fr_std from fold_scores group by 1, 2, 3",
    "paired_ttest": f"with {_FOLDS}, x as (select a.metric, a.keyword_category, a.identifier as a, b.identifier as b, avg(a.score - b.score) as m, stddev_samp(a.score - b.score) as sd, count(*) as n from fold_scores a join fold_scores b using (metric, keyword_category, fold) group by all), y as (select *, atan(abs(m * sqrt(n) / nullif(sd, 0)) / sqrt(n - 1)) as th from x) select 'dev' as split, metric, keyword_category, a, b, round(case when a = b then 1.0 when sd = 0 then (m = 0)::int when n = 5 then 1 - sin(th) * (1 + 0.5 * cos(th) * cos(th)) when n = 4 then 1 - 2 / pi() * (th + sin(th) * cos(th)) when n = 3 then 1 - sin(th) when n = 2 then 1 - 2 * th / pi() end, 6)::double as p_value from y",
    "class_scores": f"with {_PRED}, two as (select fold, lang as identifier, y as class, avg((y = p)::int) as score, count(*) as n from pred group by all) select 'recall' as metric, class::varchar as class, identifier, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0), 6) as std, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 6) as std_error, sum(n)::bigint as support from two group by class, identifier",
    "interaction_tfidf": f"with {LABELLED}, {_COUNTS}, i as (select row_id, '(lang=' || lang || ')x(tokens=' || feature || ')' as feature, value from counts join t on doc_id = row_id), w as (select feature, ln((1.0 + (select count(*) from t where doc_id % 5 > 0)) / (1.0 + count(distinct row_id))) + 1 as idf from i where row_id % 5 > 0 group by 1), x as (select row_id, feature, value * idf as v from i join w using (feature)) select row_id, 'lang x tokens' as component, feature, round(v / sqrt(sum(v * v) over (partition by row_id)), 6) as value from x",
    "task_folds": f"with {LABELLED}, r as (select doc_id, lang as keyword_category, case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'dev' else 'test' end as split from labelled), k as (select *, (row_number() over (partition by keyword_category, split order by {draw_sql('doc_id')}, doc_id) - 1) % 3 as f from r), n as (select unnest([0, 1, 2]) as run) select doc_id, keyword_category, split, run::int as run from k, n where keyword_category in ('en', 'fr') and (split = 'test' or (split = 'train' and f <> run) or (split = 'dev' and f = run))",
    "label_bias": f"with {LABELLED}, r as (select lang as category, y::varchar as target, unnest([source, 'overall']) as feature from labelled), q as (select category, target, feature, count(*) as n from r group by all) select *, round(n / sum(n) over (partition by category, feature), 6)::double as share from q",
    "distribution_facets": f"with {LABELLED} select lang, quality::varchar as quality, source, toxic::varchar as value, count(*) as n, (1 - grouping(lang) + 2 * (1 - grouping(quality)) + 4 * (1 - grouping(source)))::int as facet_set, round(count(*) / sum(count(*)) over (partition by grouping(lang), grouping(quality), grouping(source), lang, quality, source), 6)::double as share from labelled group by grouping sets ((lang, toxic), (quality, toxic), (source, toxic), (lang, quality, toxic), (lang, source, toxic), (quality, source, toxic), (lang, quality, source, toxic))",
    "learning_curve_table": f"with {_FOLDS} select identifier, metric, 50.0::double as learning_curve_train_proportion, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 6) as std_error, quantile_cont(100 + 3 * fold, 0.5)::double as train_size from fold_scores group by 1, 2",
    "metric_table": f"with {_FOLDS} select identifier, metric, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 6) as std_error from fold_scores where fold < 4 group by 1, 2",
    "group_table": f"with {_PRED}, h as (select fold, y, p, unnest([lang, 'overall']) as g from pred), side as (select fold, g, y as label, 1 as t, 0 as q, (y = p)::int as h from h union all select fold, g, p, 0, 1, 0 from h), cls as (select fold, g, label, sum(t) as t, sum(q) as q, sum(h) as h from side group by all), m as (select fold, g, sum(h) / sum(t) as a, avg(2 * h / (t + q)) as f, avg(case when q > 0 then h / q else 0 end) as pr, avg(case when t > 0 then h / t else 0 end) as r, sum(t) as s from cls group by all) select 'm' as model_type, 'dev' as split, 'lang' as group_category, g as group_subcategory, round(avg(a), 6)::double as accuracy, round(avg(f), 6)::double as f1, round(avg(pr), 6)::double as precision, round(avg(r), 6)::double as recall, sum(s)::bigint as support from m group by g",
    "topk_coefficients": "with m as (select l_returnflag as label, 'f' || l_suppkey as feature, avg(l_quantity::double) as mean, coalesce(stddev_samp(l_quantity::double), 0) / sqrt(count(*)) as std_error from lineitem group by all), r as (select *, row_number() over (partition by label order by mean desc, feature) as place from m) select label, feature, round(mean, 6) as mean, round(std_error, 6) as std_error, place::int as place from r where place <= 5",
    "task_loss": f"with {_PRED} select lang as task, count(*) as n, round(avg(-ln((1 + doc_id % 9) / 10) * 2), 6)::double as loss from pred group by 1",
    "available_splits": "select o_orderpriority as keyword_category, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as splits from orders group by 1",
    "special_cases": f"with {_PRED} select doc_id as row_id, y as y_true, p as y_baseline from pred where y <> p and case when doc_id % 8 = 0 then y else 0 end = y",
}

QUERIES = {f.__name__: f for f in (class_scores, task_folds, interaction_tfidf, target_encoding, onehot, token_counts, tfidf, interaction, represented, standardize, class_weights, task_weights, feature_crosses, mean_pool, prior, most_frequent, conditional_majority, metrics, per_class, confusion, roc, roc_thinned, auc, group_scores, errors, std_error, flatten_scores, confusion_norm, confusion_to_scores, summary_pivot, summary_display, paired_ttest, label_bias, distribution_facets, learning_curve_table, metric_table, group_table, topk_coefficients, task_loss, available_splits, logreg_predict, logreg_grid, rf_grid, rf_constrained, coefficients, batch_scoring, batch_embedding, apply_predictions, model_sweep, logistic_sweep, domain_confusion, domain_discrimination, domain_majorities, special_cases, pca_projection)}
