"""Many regressions at once against separate fits and plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.operators import many as mm
from cohortlens.operators import metrics as mt
from cohortlens.operators import models as md
from cohortlens.operators import splits as sp


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label_idx", (F.col("label") % 3).cast("double"))
    dense = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    few = array_to_vector(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")))
    return e.select("vec_id", "label_idx", dense.alias("all"), few.alias("few")).cache()


def test_equal_to_separate_fits(rows):
    masks = {f"{side} {f}": (F.col("vec_id") % 3 != f if side == "train" else F.col("vec_id") % 3 == f) for f in range(2) for side in ("train", "dev")}
    fits = [mm.Fit((v, f, c, b), v, f"train {f}", c, b) for v in ("all", "few") for f in range(2) for c, b in ((0.3, True), (3.0, False))]
    held = mm.Rows(rows, "vec_id", "label_idx", masks, ["all", "few"])
    fitted = held.fit(fits)
    assert [x.fit for x in fitted] == fits and all(x.settled for x in fitted)
    again = held.fit(fits[-2:], most_numbers=1)  # each model in passes of its own
    assert all(np.allclose(a.coefficients, b.coefficients, atol=1e-9) for a, b in zip(again, fitted[-2:], strict=True))
    said = {}
    for r in held.predict(fitted, [x.fit.train.replace("train", "dev") for x in fitted]).collect():
        said[r.fit, r.row_id] = r
    for i, f in enumerate(fits):
        fold = f.name[1]
        train, dev = (rows.where(c).withColumn("features", F.col(f.features)) for c in (masks[f"train {fold}"], masks[f"dev {fold}"]))
        model = md.logistic(train, f.c, balanced=f.balanced, max_iter=500)
        want = model.transform(dev).select("vec_id", "label_idx", vector_to_array("probability").alias("p")).collect()
        assert len(want) == sum(k[0] == i for k in said)
        for r in want:
            got = said[i, r.vec_id]
            assert got.y == r.label_idx and np.allclose(got.probabilities, r.p, atol=1e-4)
            assert got.predicted == int(np.argmax(got.probabilities))
    held.close()


def test_odd_rows(spark):
    schema = "id string, y int, a array<double>, w double"
    data = [("a", 0, [1.0, 0.0], 2.0), ("b", 2, [0.0, 1.0], 1.0), ("b", 2, [0.0, 1.0], 1.0), ("c", None, [1.0, 1.0], 1.0), (None, 0, None, 1.0), ("d", 0, [1.0, 0.0], 1.0)]
    df = spark.createDataFrame(data, schema).withColumn("v", F.when(F.col("a").isNotNull(), array_to_vector("a")))
    masks = {"some": F.col("id") < "z", "all": F.lit(True), "none": F.lit(False), "null": F.lit(None).cast("boolean")}
    held = mm.Rows(df, "id", "y", masks, ["v"], weight="w")
    fits = [mm.Fit((m, c), "v", m, c) for m in masks for c in (None, 1.0)]
    fitted = held.fit(fits)
    assert all(x.settled for x in fitted)  # separable without a penalty too
    assert all(np.isneginf(x.intercepts[1]) for x in fitted)  # class 1 has no rows
    assert all(not x.coefficients.any() for x in fitted if x.fit.train in ("none", "null"))
    said = held.predict(fitted, ["all"] * len(fits)).collect()
    assert len(said) == 5 * len(fits) and all(abs(sum(r.probabilities) - 1) < 1e-9 for r in said)
    assert all(r.predicted == r.y for r in said if fits[r.fit].train == "some" and r.row_id)
    held.close()
    empty = mm.Rows(df.limit(0), "id", "y", masks, ["v"])
    assert empty.predict(empty.fit(fits), ["all"] * len(fits)).count() == 0


def test_a_weighted_row_counts_like_repeated_ones(spark):
    data = [(i, i % 2, Vectors.sparse(3, {i % 3: 1.0}), float(1 + i % 4)) for i in range(12)]
    df = spark.createDataFrame(data, ["id", "y", "v", "w"])
    times = df.withColumn("x", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    fits = [mm.Fit((c,), "v", "all", c) for c in (0.5, 5.0)]
    a, b = mm.Rows(df, "id", "y", {"all": F.lit(True)}, ["v"], weight="w").fit(fits), mm.Rows(times, "id", "y", {"all": F.lit(True)}, ["v"]).fit(fits)
    assert all(np.allclose(x.coefficients, y.coefficients, atol=1e-5) for x, y in zip(a, b, strict=True))


def test_the_sweep_equals_separate_fits(spark, rows):
    df = rows.select(F.col("vec_id").alias("row_id"), F.concat(F.lit("c"), F.col("label_idx").cast("int")).alias("label"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("keyword_category"), ((F.col("vec_id") / 2).cast("int") % 2).alias("fold"), "few")
    table, said = md.logistic_sweep(df, ["few"], grid=(0.1, 2.0), percents=[50])
    got = {(r.keyword_category, r.fold, r.percent, r.c): r for r in table.where("metric = 'macro_f1'").collect()}
    assert len(got) == 2 * 2 * 2 * 2
    for task in {k[:3] for k in got}:
        chosen = [r.c for k, r in got.items() if k[:3] == task and r.chosen]
        best = max(r.score for k, r in got.items() if k[:3] == task)
        assert chosen == [min(r.c for k, r in got.items() if k[:3] == task and r.score == best)]
    spread = df.select("row_id", "keyword_category", "label", F.explode(F.array(F.lit(0), F.lit(1))).alias("__run"), "fold").where("__run <> fold").drop("fold")
    sets = sp.learning_curve(spread, "row_id", "label", [50], 1, by=["keyword_category", "__run"])
    idx = df.withColumns({"label_idx": F.substring("label", 2, 1).cast("double"), "features": F.col("few")}).cache()
    for (category, fold, percent, c), r in got.items():
        if category == "even" and fold == 1:
            held = sets.where((F.col("keyword_category") == category) & (F.col("__run") == fold) & (F.col("percent") == percent))
            train, dev = idx.join(held, "row_id", "left_semi").cache(), idx.where((F.col("keyword_category") == category) & (F.col("fold") == fold))
            assert train.count() == r["size"] and not train.where("fold = 1 or keyword_category = 'odd'").count()
            predicted = md.predict_vectors(md.logistic(train, c, max_iter=500), dev, ["c0", "c1", "c2"])
            want = mt.scores(predicted, "label", "predicted_label").where("metric = 'macro_f1'").first().score
            assert abs(r.score - want) < 1e-9
    per_task = said.groupBy("keyword_category", "fold", "percent").count().collect()
    assert len(per_task) == 8 and sum(r["count"] for r in per_task) == 2 * df.count()


def test_curves_within_groups(spark):
    df = spark.range(400).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("y"))
    curve = sp.learning_curve(df, "id", "y", [1, 25], 2, by=["g"])
    n = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    for r in curve.groupBy("g", "percent", "iteration").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("y").alias("k"), F.max("size").alias("size")).collect():
        assert r.n == r.ids == r["size"] == max(int(n[r.g] * r.percent / 100), 7) and r.k == 7
    assert sp.learning_curve(df.limit(0), "id", "y", [50], by=["g"]).count() == 0


def test_ten_discriminators(spark, sf_dir):
    """Names, whole groups, and each regression on crosses by the shares of its train rows' tuples: a saturated model's optimum."""
    from cohortlens.plans.common import labelled
    from cohortlens.plans.models import _discriminated

    docs = {r.doc_id: r for r in labelled(spark, sf_dir).select("doc_id", "toxic", "source", "quality", "lang").collect()}
    got = _discriminated(spark, sf_dir).collect()
    said = {}
    for r in got:
        assert (r.discriminator, r.row_id) not in said and r.y_true == docs[r.row_id].toxic
        said[r.discriminator, r.row_id] = r
    names = {n for n, _ in said}
    crosses = [("source", "quality"), ("source", "lang"), ("quality", "lang"), ("source", "quality", "lang")]
    assert names == {"most_frequent", *(f"majority_given_{c}" for c in ("source", "quality", "lang")), *(f"logistic_{'_x_'.join(c)}" for c in crosses), "logistic_words", "logistic_words_neutral"}
    assert len(said) == 10 * len(docs)
    fold = {i: said["most_frequent", i].fold for i in docs}
    assert all(r.fold == fold[r.row_id] for r in got) and set(fold.values()) == set(range(5))
    assert all(fold[i] == fold[j] for i in docs for j in docs if i // 3 == j // 3)
    for some in crosses:
        held = 0
        for i, d in docs.items():
            same = [o.toxic for j, o in docs.items() if fold[j] != fold[i] and all(o[c] == d[c] for c in some)]
            if same and 2 * sum(same) != len(same):
                held += 1
                assert said[f"logistic_{'_x_'.join(some)}", i].y_pred == (2 * sum(same) > len(same))
        assert held > len(docs) / 3


def test_a_forest_by_repeated_constrained_draws(spark, rows):
    from pyspark.ml.classification import RandomForestClassifier

    df = rows.select("vec_id", "label_idx", F.col("label_idx").cast("int").alias("y"), F.col("few").alias("features"))
    model, best, found = md.constrained_forest(df, "vec_id", "y", [0, 1, 2], draws=2, trees=5, depths=(None, 3), min_splits=(2, 8))
    want = []
    for depth, least in ((30, 1), (30, 4), (3, 1), (3, 4)):
        each = []
        for i in range(2):
            held = sp.constrained_resample(df, "vec_id", "y", 0.2, seed=42 + i)
            forest = RandomForestClassifier(labelCol="label_idx", numTrees=5, maxDepth=depth, minInstancesPerNode=least, seed=42).fit(held.where("part = 'train'"))
            said = forest.transform(held.where("part = 'test'")).select("y", F.col("prediction").cast("int").alias("p"))
            each.append(mt.scores(said, "y", "p").where("metric = 'macro_f1'").first().score)
        want.append(sum(each) / 2)
    got = [s for _, s in found]
    assert [p for p, _ in found] == [(None, 2), (None, 8), (3, 2), (3, 8)] and best == found[got.index(max(got))][0]
    assert np.allclose(got, want, atol=0.15) and model.getNumTrees == 5  # a forest's draws follow the partitions of its rows


def test_first_rows_are_the_first(spark):
    data = [(i, i % 3 if i % 11 else None, [5, 5, None, 1, 9, 2, 2][i % 7]) for i in range(200)]
    df = spark.createDataFrame(data, "id int, g int, o int")
    for n in (0, 1, 7, 30, 500):
        got = {}
        for r in sp.first_rows(df, F.col("o"), "id", ["g"], F.lit(n)).collect():
            got.setdefault(r.g, set()).add(r.id)
        for g in (0, 1, 2, None):
            of = sorted((o is not None, o or 0, i) for i, h, o in data if h == g)
            assert got.get(g, set()) == {i for *_, i in of[:n]}
    assert sp.first_rows(df.limit(0), F.col("o"), "id", ["g"], F.lit(3)).count() == 0


def test_thinning_across_steps_and_groups(spark):
    rng = np.random.default_rng(3)
    data = [(g, float(t), int(rng.integers(0, 3)), int(rng.integers(0, 3))) for g in ("a", "b") for t in np.unique(rng.integers(0, 4000, 60)) / 1000]
    df = spark.createDataFrame([(g, t, p) for g, t, neg, pos in data for p in [0] * neg + [1] * pos], "g string, s double, p int")
    curve = mt.roc_curve(df, F.col("p") == 1, "s", ["g"], bins=2)
    got = {(r.g, r.threshold) for r in mt.thinned(curve, ["g"], bins=2).collect()}
    for g in ("a", "b"):
        points = sorted(((r.threshold, r.fp, r.tp) for r in curve.where(F.col("g") == g).collect()), reverse=True)
        for k, (t, x, y) in enumerate(points):
            _, x0, y0 = points[k - 1] if k else (0, 0, 0)
            on = k + 1 < len(points) and (x - x0) * (points[k + 1][2] - y) == (points[k + 1][1] - x) * (y - y0)
            assert ((g, t) in got) != on


def test_pooled_vectors(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [True, True, False]), (2, [[5.0, 6.0], None], [True, True]), (3, [[1.0, 1.0]], [False]), (4, None, None)], "id int, v array<array<double>>, m array<boolean>")
    from cohortlens.operators import features as ft

    assert {r.row_id: r.vector for r in ft.mean_pool(df, "id", "v", "m").collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0]}


def test_a_pass_works_on_the_places_of_its_rows_only(spark, monkeypatch):
    """Words that a category's rows lack are no numbers of its models, and few passes settle them."""
    data = [(i, i // 2 % 2, i % 2, Vectors.sparse(400, sorted((200 * (i % 2) + (7 * i * j + j) % 200, 1.0 / j) for j in {1, 2, 3, 5, 9} if (7 * i * j + j) % 200 not in {(7 * i * h + h) % 200 for h in {1, 2, 3, 5, 9} if h < j}))) for i in range(300)]
    df = spark.createDataFrame(data, ["id", "y", "g", "v"])
    held = mm.Rows(df, "id", "y", {"train 0": F.col("g") == 0, "train 1": F.col("g") == 1}, ["v"])
    seen = []
    gradients = held._gradients
    monkeypatch.setattr(held, "_gradients", lambda models, *a: seen.append({i: len(m[4]) for i, m in models.items()}) or gradients(models, *a))
    fitted = held.fit([mm.Fit((g,), "v", f"train {g}", 3.0) for g in range(2)])
    assert all(n <= 2 * 201 for one in seen for n in one.values()) and len(seen) < 60 and all(x.settled for x in fitted)
    assert not fitted[0].coefficients[:, 200:].any() and not fitted[1].coefficients[:, :200].any()
    held.close()


def test_forests_hold_few_trees_at_a_time(rows, monkeypatch):
    """Groups of trees vote like one forest; settings that MLlib's depth makes one are fitted once, for both choices."""
    df = rows.select("vec_id", "label_idx", F.col("label_idx").cast("int").alias("y"), F.col("few").alias("features"))
    grown, forest = [], md._forest
    monkeypatch.setattr(md, "_forest", lambda train, depth, least, trees, seed: grown.append((depth, least, trees, seed)) or forest(train, depth, least, trees, seed))
    whole = md.constrained_forest(df, "vec_id", "y", [0, 1, 2], draws=1, trees=6, depths=(None,), min_splits=(2,), refit=False)
    assert whole[0] is None and grown == [(30, 1, 6, 42)]
    monkeypatch.setattr(md, "_GROWN", 2 * df.count())
    few = md.constrained_forest(df, "vec_id", "y", [0, 1, 2], draws=1, trees=6, depths=(None,), min_splits=(2,), refit=False)
    assert [g[2:] for g in grown[1:]] == [(2, 42), (2, 44), (2, 46)] and abs(few[2][0][1] - whole[2][0][1]) < 0.15
    grown.clear()
    model, _, found = md.forest_grid(df.where("vec_id % 5 > 0"), df.where("vec_id % 5 = 0"), [0, 1, 2], "y", trees=3, depths=(None, 50), min_splits=(2, 3))
    assert len(grown) == 1 and len(found) == 4 and len({s for _, s in found}) == 1 and model.getNumTrees == 3


def test_a_pass_reads_the_blocks_of_its_masks_only(spark):
    """Rows of equal masks lie together, a block lists its places once, and sums over stretches and empty rows are the plain ones."""
    data = [(i, i % 2, i % 2, Vectors.sparse(100_000, sorted({(i * j * 7919) % 100_000: 1.0 for j in range(1, 200)}.items()))) for i in range(4000)]
    df = spark.createDataFrame(data, ["id", "y", "g", "v"]).coalesce(1)
    held = mm.Rows(df, "id", "y", {"train 0": F.col("g") == 0, "train 1": F.col("g") == 1}, ["v"])
    n = held.df.count()
    assert n >= 3 and held._parts(["v"], [0]).count() <= n / 2 + 1 and held._parts(["v"], [0, 1]).count() == n
    held.close()
    rng = np.random.default_rng(1)
    lengths = np.array([0, 3, 40_000, 0, 1, 0])
    starts, w = np.concatenate([[0], np.cumsum(lengths)]), rng.normal(size=(3, 50))
    places, values = rng.integers(0, 50, lengths.sum()), rng.normal(size=lengths.sum())
    want = [(w[:, places[a:b]] * values[a:b]).sum(axis=1) for a, b in zip(starts, starts[1:])]
    assert np.allclose(mm._scores(w, starts, places, values), want)
    assert np.allclose(mm._scores(w, starts[2:4], places, values), want[2:3]) and mm._scores(w, starts[:1], places, values).shape == (0, 3)


def test_forests_grow_from_counts_and_from_rows_alike(spark, rows, monkeypatch):
    """One growth serves all depths of a setting; a forest whose upper nodes are split from counts is as good, scores each row once and gives importances that add up to 1."""
    from cohortlens.operators import forests as fo

    df = rows.select("vec_id", "label_idx", F.col("label_idx").cast("int").alias("y"), F.when(F.col("vec_id") % 2 == 0, array_to_vector(F.array(*[F.get(vector_to_array("few"), F.lit(i)) + (3 if i == 2 else 0) * F.col("label_idx") for i in range(5)]))).otherwise(F.col("few")).alias("features")).where("vec_id % 2 = 0").cache()
    train, dev = df.where("vec_id % 10 > 0"), df.where("vec_id % 10 = 0")
    grown, made = [], md._forest
    monkeypatch.setattr(md, "_forest", lambda *a: grown.append(a[1:]) or made(*a))
    model, _, found = md.forest_grid(train, dev, [0, 1, 2], "y", trees=6, depths=(None, 3, 5), min_splits=(2, 4))
    assert [g[:2] for g in grown] == [(30, 1), (30, 2)] and len(found) == 6 and min(s for _, s in found) > 0.8
    monkeypatch.setattr(fo, "_TOGETHER", 60)
    forest = fo.Forest(train, 30, 1, 6, 42)
    said = forest.votes(dev, [2, 30]).collect()
    assert sorted(r.vec_id for r in said) == sorted(r.vec_id for r in dev.collect())
    assert all(abs(sum(r[f"votes {d}"]) - 6) < 1e-9 for r in said for d in (2, 30))
    assert np.mean([np.argmax(r["votes 30"]) == r.y for r in said]) > 0.8
    for f in (forest, model):
        assert abs(f.featureImportances.toArray().sum() - 1) < 1e-9 and np.argmax(f.featureImportances.toArray()) == 2
    assert {r.vec_id: r.rawPrediction.toArray().tolist() for r in forest.transform(dev).collect()} == {r.vec_id: list(r["votes 30"]) for r in said}
    df.unpersist()


def test_the_best_split_is_that_of_a_plain_loop():
    from cohortlens.operators import forests as fo

    rng = np.random.default_rng(0)
    for _ in range(60):
        n, least = int(rng.integers(2, 30)), int(rng.integers(1, 4))
        x, y, w, node = rng.integers(0, 6, (n, 3)).astype(np.uint8), rng.integers(0, 3, n), rng.integers(1, 4, n), rng.integers(0, 2, n)
        gain, feature, last = fo._splits(x, y, w, node, np.tile(np.arange(3), (2, 1)), np.bincount(node * 3 + y, w, 6).reshape(2, 3), least)
        for o in range(2):
            gini = lambda q, y=y, w=w: 1 - sum((w[q & (y == c)].sum() / w[q].sum()) ** 2 for c in range(3))
            held, worth = node == o, {}
            for j in range(3):
                for s in range(6):
                    a, b = held & (x[:, j] <= s), held & (x[:, j] > s)
                    if w[a].sum() >= least and w[b].sum() >= least:
                        worth[j, s] = gini(held) - (w[a].sum() * gini(a) + w[b].sum() * gini(b)) / w[held].sum()
            assert abs(max([0, *worth.values()]) - gain[o]) < 1e-9 and (not gain[o] or abs(worth[feature[o], last[o]] - gain[o]) < 1e-9)


def test_two_classes_are_fitted_by_their_difference(spark, monkeypatch):
    """Half the numbers, and the weights of a fit that has both classes: their penalised loss is flat."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(120, 4)), rng.integers(0, 2, 120) * 2
    df = spark.createDataFrame([(i, int(c), Vectors.dense(v)) for i, (v, c) in enumerate(zip(x.tolist(), y, strict=True))] + [(900, 1, Vectors.dense([0.0] * 4))], ["id", "y", "v"])
    held = mm.Rows(df, "id", "y", {"two": F.col("y") != 1}, ["v"])
    seen, gradients = [], held._gradients
    monkeypatch.setattr(held, "_gradients", lambda models, *a: seen.append({len(m[4]) for m in models.values()}) or gradients(models, *a))
    (found,) = held.fit([mm.Fit(("two",), "v", "two", 0.5, False)], tol=1e-9)
    assert all(s == {5} for s in seen) and found.settled and not found.weights[1].any() and np.isneginf(found.intercepts[1])
    w, b = found.weights[[0, 2]], found.intercepts[[0, 2]]
    p = np.exp(x @ w.T + b)
    p = p / p.sum(axis=1, keepdims=True) - (y[:, None] == [0, 2])
    assert np.abs(p.T @ x + w / 0.5).max() < 1e-5 and np.abs(p.sum(axis=0)).max() < 1e-5
    held.close()


def test_vocabularies_are_learned_side_by_side(spark, monkeypatch):
    """Each column's vectors are those of its own counts; no vocabulary waits for the other."""
    import threading

    from cohortlens.operators import stages as sg
    from cohortlens.plans.models import _word_vectors

    both, fit = threading.Barrier(2, timeout=60), sg.FeatureStage._fit
    monkeypatch.setattr(sg.FeatureStage, "_fit", lambda self, df: both.wait() is not None and fit(self, df))
    df = spark.createDataFrame([(1, ["a", "b", "b"], ["c"]), (2, ["a"], ["c", "d", "d"]), (3, [], None)], "id int, x array<string>, z array<string>")
    rows = _word_vectors(df, {"x vec": "x", "z vec": "z"}, 2).select("id", vector_to_array("x vec").alias("vx"), vector_to_array("z vec").alias("vz")).collect()
    made = {r.id: (r.vx, r.vz) for r in rows}
    want = {1: ([1, 2], [1, 0]), 2: ([1, 0], [1, 2]), 3: ([0, 0], [0, 0])}
    for i, pair in want.items():
        for got, v in zip(made[i], pair, strict=True):
            assert np.allclose(got, np.array(v) / max(np.linalg.norm(v), 1e-300))
