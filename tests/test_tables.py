import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortlens.operators import cohort as co
from cohortlens.operators import compare as cp
from cohortlens.operators import features as ft
from cohortlens.operators import guards
from cohortlens.operators import metrics as mt
from cohortlens.operators import models as md
from cohortlens.operators import splits as sp
from cohortlens.sources import hospital, results
from cohortlens.streaming import search as ss


def test_every_query_with_sql_is_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    plain = {k: v for k, v in queries.items() if not re.match(r"op\d+_|pipeline", k)}
    assert len(plain) > 100 and len([k for k in plain if k in sql]) > 90


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not re.match(r"op\d+_|pipeline", k)))
def test_queries_equal_their_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    flat = lambda v: round(v, 5) if isinstance(v, float) else v
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([flat(r[c]) for c in cols]) for r in df.collect())
    rows = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == cols
    assert got == sorted(repr([flat(r[names.index(c)]) for c in cols]) for r in rows.fetchall())


def test_features_must_be_the_learned_ones(spark):
    a = spark.createDataFrame([("c", "x"), ("c", "y")], "component string, feature string")
    assert ft.same_features(a, a).count() == 2
    for b in (a.limit(1), a.union(spark.createDataFrame([("c", "z")], a.schema))):
        with pytest.raises(ValueError):
            ft.same_features(a, b)


def test_t_test_counts_the_folds_it_finds(spark):
    rows = [("a", f, 1.0 * f) for f in range(5)] + [("b", f, 1.0 * f + (0.1, 0.4, 0.2)[f]) for f in range(3)] + [("c", 0, 0.3)]
    scores = spark.createDataFrame([("dev", "f1", "k", *r) for r in rows], "split string, metric string, keyword_category string, identifier string, fold int, score double")
    p = {(r.a, r.b): r.p_value for r in cp.paired_t_tests(scores, 5).collect()}
    assert abs(p["a", "b"] - 0.11808) < 1e-4 and p["a", "c"] is None and p["a", "a"] == 1.0


def test_null_keywords_stay_when_others_are_removed(spark):
    rows = spark.createDataFrame([(1, "good", "a good day"), (2, None, "none"), (3, "bad", "bad day")], "encounter_id long, keyword string, note_text string")
    meta = spark.createDataFrame([(1,), (2,), (3,)], "encounter_id long")
    with pytest.warns(UserWarning, match="absent"):
        out, _ = co.prepare_model_data(rows, meta, "encounter_id", remove=["good", "absent"])
    assert sorted(r.encounter_id for r in out.collect()) == [2, 3]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_guards(spark, tmp_path):
    df = spark.range(2)
    with pytest.raises(KeyError, match="a.*b"):
        guards.require_columns(df, "id", "a", "b")
    with pytest.raises(ValueError):
        guards.none_left(df, "bad")
    with pytest.raises(FileNotFoundError, match="x.*y"):
        guards.validate_inputs(spark, {"x": f"{tmp_path}/no", "y": f"{tmp_path}/none"})


def test_hospital_tables_and_notes(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "services.csv.gz", "wt") as f:
        f.write("subject_id,hadm_id,transfertime,curr_service\n1,10,2100-01-01 00:00:00,MED\n1,10,2100-01-02 00:00:00,SURG\n")
    with open(tmp_path / "transfers.csv", "w") as f:
        f.write("subject_id,hadm_id,transfer_id,eventtype,careunit,intime,outtime\n1,10,1,admit,Ward,2100-01-01 00:00:00,\n1,10,2,transfer,ICU,2100-01-02 00:00:00,\n1,10,3,discharge,,2100-01-03 00:00:00,\n1,,4,discharge,ED,2100-02-01 00:00:00,\n")
    with open(tmp_path / "discharge.csv", "wb") as f:
        f.write('note_id,subject_id,hadm_id,note_type,note_seq,charttime,storetime,text\nn1,1,10,DS,1,2100-01-03,2100-01-03,"caf\xe9 ""q""\nsecond line"\n'.encode("latin-1"))
    services, transfers = hospital.read_table(spark, f"{tmp_path}/services.csv.gz", "services"), hospital.read_table(spark, f"{tmp_path}/transfers.csv", "transfers")
    row = hospital.load_notes(hospital.read_notes(spark, f"{tmp_path}/discharge.csv"), services, transfers).first()
    assert (row.encounter_note_id, row.encounter_note_service, row.encounter_note_unit) == ("n1", "SURG", "ICU")
    assert row.note_text == 'cafe "q" second line'
    assert sorted(r.hadm_id for r in co.number_lone_transfers(transfers).collect()) == [-1, 10, 10, 10]
    with pytest.raises(ValueError):
        co.service_and_unit(services, transfers.where("eventtype <> 'discharge'"))
    with pytest.raises(KeyError):
        hospital.read_table(spark, f"{tmp_path}/services.csv.gz", "nothing")


def test_annotations_must_have_their_columns(spark, tmp_path):
    with open(tmp_path / "a.csv", "w") as f:
        f.write("encounter_id,label\n1,x\n")
    with pytest.raises(KeyError, match="keyword"):
        hospital.read_annotations(spark, f"{tmp_path}/a.csv")


def test_results_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([("lr", "f", "t", "adamant", 0, "dev", 100.0, 0, 10, "f1", None, 0.5, None), ("x", "y", "t", "adamant", 0, "dev", 100.0, 0, 10, "f1", None, 0.1, None)], results.SCORE_SCHEMA)
    results.write_scores(scores, f"{tmp_path}/s")
    names = spark.createDataFrame([("lr", "f", "LR", 0)], "model_type string, feature_set string, identifier string, ord int")
    held = results.read_scores(spark, f"{tmp_path}/s", names).collect()
    assert [(r.identifier, r.score) for r in held] == [("LR", 0.5)]
    results.write_errors(spark.createDataFrame([("a", "dev", 1)], "keyword_category string, split string, y int"), f"{tmp_path}/e")
    assert (tmp_path / "e" / "keyword_category=a" / "split=dev").exists()
    results.write_predictions(spark.createDataFrame([("a", "text", 0.5)], "keyword_category string, note_text string, p double"), f"{tmp_path}/p", keep_text=False)
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["p", "keyword_category"]


def test_splits_keep_their_promises(spark):
    df = spark.range(3000).select("id", (F.col("id") % 600).alias("g"), F.when(F.col("id") % 50 == 0, "rare").otherwise("common").alias("y"))
    split = sp.no_leak(sp.group_split(df, "g"), "g")
    share = {r.split: r["count"] / 3000 for r in split.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.7) < 0.06 and abs(share["test"] - 0.1) < 0.05
    folds = [r["count"] for r in sp.k_folds(df, 7).groupBy("fold").count().collect()]
    assert len(folds) == 7 and max(folds) - min(folds) <= 1
    curve = sp.learning_curve(df, "id", "y", [1, 50], 2).groupBy("percent", "iteration").agg(F.count("*").alias("n"), F.count_distinct("y").alias("k")).collect()
    assert {(r.percent, r.n, r.k) for r in curve} == {(1.0, 30, 2), (50.0, 1500, 2), (100.0, 3000, 2)}
    for most in (10, 1_000_000):
        part = sp.constrained_resample(df, "id", "y", 0.2, 2, 3, most_exact=most).groupBy("part", "y").count().collect()
        assert all(r["count"] >= (2 if r.part == "train" else 3) for r in part) and len(part) == 4
    with pytest.raises(ValueError):
        sp.constrained_resample(df, "id", "y", 0.2, 50, 50)


def test_constrained_resample_is_exact_at_every_size(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise("common").alias("y"))
    rows = sorted((r.draw, r.id, r.y) for r in df.withColumn("draw", sp.drawn("id")).collect())
    want, rest = set(), []
    for y in (None, "common"):
        mine = [r[:2] for r in rows if r[2] == y]
        want |= set(mine[:3])
        rest += mine[5:]
    want |= set(sorted(rest)[: 600 - len(want)])
    for most in (10, 1_000_000):
        got = sp.constrained_resample(df, "id", "y", 0.2, 2, 3, most_exact=most).collect()
        assert len(got) == 3000 and {r.id for r in got if r.part == "test"} == {i for _, i in want}


def test_conditional_majority(spark):
    train = spark.createDataFrame([("a", "p"), ("a", "p"), ("a", "n"), ("b", "n")], "x string, y string")
    model = md.ConditionalMajority(1.0).fit(train, "x", "y")
    p = {r.x: r.probabilities for r in model.predict(spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "x string")).collect()}
    assert model.labels == ["n", "p"] and p["a"] == [0.4, 0.6] and p["new"] == [0.5, 0.5] and p[None] == [0.5, 0.5]
    assert all(abs(sum(v) - 1) < 1e-12 for v in p.values())
    assert model.predict(spark.createDataFrame([("new",)], "x string")).first().predicted_label == "n"


def test_metric_identities(spark):
    rows = spark.createDataFrame([(i, i % 3, (i * 7 % 11) % 3) for i in range(100)], "id int, y int, p int")
    s = {r.metric: r.score for r in mt.scores(rows, "y", "p").collect()}
    assert abs(s["micro_f1"] - s["accuracy"]) < 1e-12
    assert abs(s["accuracy"] - rows.where("y = p").count() / 100) < 1e-12
    back = cp.confusion_scores(mt.confusion(rows, "y", "p")).first()
    assert abs(back.f1 - s["macro_f1"]) < 1e-12 and abs(back.accuracy - s["accuracy"]) < 1e-12
    assert mt.confusion(rows, "y", "p", spark.createDataFrame([(k,) for k in range(4)], "label int")).count() == 16


def test_auc_and_curve(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 0)], "s double, y int")
    curve = mt.roc_curve(rows, F.col("y") == 1, "s")
    assert abs(mt.auc(curve).first().auc - 5.5 / 6) < 1e-12
    assert mt.thinned(curve).count() <= curve.count()
    assert mt.auc(mt.roc_curve(rows.where("y = 1"), F.col("y") == 1, "s")).first().auc is None


def test_t_distribution(spark):
    one = spark.range(1)
    assert abs(one.select(cp.t_two_sided(F.lit(2.3), 4).alias("p")).first().p - 0.08294) < 1e-4
    assert abs(one.select(cp.t_two_sided(F.lit(1.0), 1).alias("p")).first().p - 0.5) < 1e-9
    assert abs(one.select(cp.t_two_sided(F.lit(2.0), 3).alias("p")).first().p - 0.13933) < 1e-4


def test_features(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "id int, tokens array<string>")
    counts = ft.count_features(df, "id", "tokens", spark.createDataFrame([("a",), ("b",)], "token string"))
    rows = ft.tfidf(counts, ft.idf(counts, 3)).groupBy("row_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in rows) and len(rows) == 2
    assert [(r.feature, r["index"]) for r in ft.feature_index(counts, ["tokens"]).orderBy("index").collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(KeyError):
        ft.represent({"a": counts}, ["b"])
    with pytest.raises(ValueError):
        ft.disjoint({"c": [["a", "b"], ["b"]]})
    mask = df.select(ft.anchor_mask(F.col("tokens"), F.array(F.lit("a")), "keyword").alias("m")).collect()
    assert mask[0].m == [True, False, False] or mask[0].m == [False, False, True]
    pooled = ft.mean_pool(spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [True, True, False])], "id int, v array<array<double>>, m array<boolean>"), "id", "v", "m").first()
    assert pooled.vector == [2.0, 4.0]


def test_logistic_regression_meets_its_penalty(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(float(i % 3), Vectors.dense([math.sin(i) + i % 3, math.cos(3 * i)])) for i in range(90)], ["label_idx", "features"])
    model = md.logistic(rows, 0.3)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    import numpy as np

    x, y = np.array([r.features.toArray() for r in rows.collect()]), np.array([int(r.label_idx) for r in rows.collect()])
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    grad = 0.3 * (p - np.eye(3)[y]).T @ x + w
    assert np.abs(grad).max() < 1e-3


def test_apply_predictions_scores_every_document(spark, sf_dir):
    rows = entry.queries()["apply_predictions"](spark, sf_dir).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.predicted_label == r.probabilities.index(max(r.probabilities)) for r in rows)


def test_model_sweep_and_grid_do_the_whole_job(spark, sf_dir):
    swept = entry.queries()["model_sweep"](spark, sf_dir).select("keyword_category").distinct().collect()
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    assert {r[0] for r in swept} == {r[0] for r in docs.join(labels, "doc_id").select("lang").distinct().collect()}
    grid = entry.queries()["logreg_grid"](spark, sf_dir).collect()
    assert {r.c for r in grid} == set(md.C_GRID) and sum(r.chosen for r in grid) == 1


def test_forest_grid_uses_its_defaults(monkeypatch):
    from cohortlens.plans import models as plans

    seen = []

    class Seen(Exception):
        pass

    def grid(*given, **named):
        seen.append((given, named))
        raise Seen

    class Rows:
        def withColumn(self, *_):
            return self

        def where(self, condition):
            return condition

    monkeypatch.setattr(plans, "_vectors", lambda *_: Rows())
    monkeypatch.setattr(plans.F, "col", lambda _: 0)
    monkeypatch.setattr(plans.md, "forest_grid", grid)
    with pytest.raises(Seen):
        plans.rf_grid(None, "")
    assert seen == [(("part <> 1", "part = 1", [0, 1, 2], "y"), {})]


def test_registry_and_saved_models(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    registry = md.Registry({"m": md.Registered("baseline", {"adamant": "/p"}), "n": md.Registered("neural", {"adamant": "/q"})})
    assert registry.resolve("m", "adamant", "baseline") == "/p" and registry.resolve("/some/path", "x", "baseline") == "/some/path"
    with pytest.raises(KeyError):
        registry.resolve("m", "other", "baseline")
    with pytest.raises(ValueError):
        registry.resolve("n", "adamant", "baseline")
    assert registry.show(spark).count() == 2
    rows = spark.createDataFrame([(0.0, Vectors.dense([0.0])), (1.0, Vectors.dense([1.0]))] * 5, ["label", "features"])
    md.save(spark, Pipeline(stages=[LogisticRegression()]).fit(rows), f"{tmp_path}/m", ["a", "b"], {"c": 1})
    model, labels, parameters = md.load(spark, f"{tmp_path}/m")
    assert labels == ["a", "b"] and parameters == {"c": "1"} and model.transform(rows).count() == 10


def test_stream_gives_the_batch_hits(spark, tmp_path):
    from cohortlens.operators.lexicon import DEMO
    from cohortlens.operators.search import search

    for k in range(3):
        spark.createDataFrame([(k * 10 + i, "the cat is here and that was it") for i in range(5)], "document_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = ss.stream_search(ss.read_texts(spark, f"{tmp_path}/in", batch.schema), DEMO)
    got = ss.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/progress")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search(batch, DEMO).collect()))
    timed = ss.read_texts(spark, f"{tmp_path}/in", batch.schema).withColumn("ts", F.timestamp_seconds("document_id"))
    assert ss.windowed_counts(timed, DEMO, "ts", "10 seconds", "0 seconds").isStreaming and ss.stream_counts(timed, DEMO).isStreaming


def test_the_stream_query_reads_a_folder_of_files(spark, sf_dir, tmp_path):
    from cohortlens.plans.text import stream_search_hits

    whole = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = sorted(map(tuple, stream_search_hits(spark, sf_dir).collect()))
    assert want and sorted(map(tuple, stream_search_hits(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("limit", [(1 << 20, 32 << 20), (0, 0)])
def test_counts_move_whole_token_lists_once(spark, sf_dir, monkeypatch, limit):
    """Terms are sent to tasks while they are few, so that counts of words are never moved; beyond that they are joined, with the same rows."""
    from cohortlens.plans import models as plans

    monkeypatch.setattr(ft, "_SENT", limit)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # only what is marked is sent
    try:
        counts = plans._counts(spark, sf_dir)[1]
        moved = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("hashpartitioning(")
        assert moved == 1 if limit[0] else moved > 1
        rows, held = plans.interaction_tfidf(spark, sf_dir).collect(), {(r.row_id, r.feature) for r in counts.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    squares = Counter()
    for r in rows:
        squares[r.row_id] += r.value**2
    assert rows and all(abs(n - 1) < 1e-3 for n in squares.values())
    assert {(r.row_id, r.feature.split("tokens=")[1][:-1]) for r in rows} <= held
