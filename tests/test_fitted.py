"""Queries without SQL against plain versions over the whole tables."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])


def macro_f1(pairs):
    labels = {x for p in pairs for x in p}
    hit, true, said = Counter(y for y, p in pairs if y == p), Counter(y for y, _ in pairs), Counter(p for _, p in pairs)
    return sum(2 * hit[k] / (true[k] + said[k]) for k in labels) / len(labels)


def commonest(values):
    counts = Counter(values)
    return min(counts, key=lambda k: (-counts[k], k))


def test_batch_scoring(spark, sf_dir, vectors):
    ids, x, _ = vectors
    z = np.stack([x[:, k::3].sum(axis=1) for k in range(3)], axis=1)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    got = {r.vec_id: r for r in entry.queries()["batch_scoring"](spark, sf_dir).collect()}
    assert sorted(got) == ids
    for i, want in zip(ids, p, strict=True):
        assert np.allclose(got[i].probabilities, want, atol=1e-6) and got[i].predicted_label == "abc"[int(np.argmax(got[i].probabilities))]


def test_batch_embedding(spark, sf_dir, vectors):
    ids, x, _ = vectors
    got = {r.vec_id: r.vector for r in entry.queries()["batch_embedding"](spark, sf_dir).collect()}
    assert sorted(got) == ids and np.allclose([got[i] for i in ids], np.tanh(x[:, :8]), atol=1e-6)


def test_pca_projection(spark, sf_dir, vectors):
    ids, x, label = vectors
    got = entry.queries()["pca_projection"](spark, sf_dir).collect()
    for name, held in (("all", label >= 0), ("low", np.isin(label, [0, 1, 2]))):
        mine = {r.vec_id: (r.x, r.y) for r in got if r.subset == name}
        part = x[held]
        axes = np.linalg.svd(part - part.mean(axis=0), full_matrices=False)[2][:2]
        want = part @ axes.T
        have = np.array([mine[i] for i, h in zip(ids, held, strict=True) if h])
        assert len(mine) == held.sum() and np.allclose(np.abs(have), np.abs(want), atol=1e-4)
    assert not [r for r in got if r.subset == "none"]


def test_coefficients_are_at_the_optimum(spark, sf_dir, vectors):
    _, x, label = vectors
    y = label % 3
    w = np.zeros((3, x.shape[1]))
    for r in entry.queries()["coefficients"](spark, sf_dir).collect():
        w[int(r.label), int(r.feature[1:])] = r.coefficient
    each = (len(y) / 3 / np.bincount(y, minlength=3))[y]

    def loss(v, b):
        z = x @ v.T + b
        return (each * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])).sum() + (v**2).sum() / (2 * 0.3)

    b = np.zeros(3)
    for _ in range(200):  # the intercepts alone, by steps along their gradient
        p = np.exp(x @ w.T + b)
        p /= p.sum(axis=1, keepdims=True)
        b -= 2 * (each[:, None] * (p - np.eye(3)[y])).mean(axis=0)
    p = np.exp(x @ w.T + b)
    p /= p.sum(axis=1, keepdims=True)
    grad = (each[:, None] * (p - np.eye(3)[y])).T @ x + w / 0.3
    assert np.abs(grad).max() < 0.02 * len(y) ** 0.5
    assert all(loss(w, b) <= loss(w + 0.01 * np.random.default_rng(k).normal(size=w.shape), b) for k in range(5))


def test_domain_majorities(spark, sf_dir):
    got = entry.queries()["domain_majorities"](spark, sf_dir).collect()
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lang = {r.doc_id: (r.source, r.lang) for r in docs.join(labels, "doc_id").select("doc_id", "source", "lang").collect()}
    base = [r for r in got if r.discriminator == "most_frequent"]
    assert Counter(r.row_id for r in base) == Counter({i: 1 for i in lang})
    fold = {r.row_id: r.fold for r in base}
    of_source = {}
    for i, f in fold.items():
        assert of_source.setdefault(lang[i][0], f) == f  # groups stay whole
    rows = [(r.row_id, r.fold, r.y_true) for r in base]
    for r in got:
        train = [(i, y) for i, f, y in rows if f != r.fold]
        same = [y for i, y in train if r.discriminator == "most_frequent" or lang[i][1] == lang[r.row_id][1]]
        assert r.y_pred == commonest(same)


def test_model_sweep(spark, sf_dir):
    from cohortlens.operators.splits import k_folds
    from cohortlens.plans.common import labelled

    rows = k_folds(labelled(spark, sf_dir).select("doc_id", "y", "lang", "source"), 3, ["lang"], "doc_id").collect()
    got = {(r.model_type, r.keyword_category, r.fold, r.metric): r.score for r in entry.queries()["model_sweep"](spark, sf_dir).collect()}
    for lang in {r.lang for r in rows}:
        for fold in range(3):
            train = [r for r in rows if r.lang == lang and r.fold != fold]
            dev = [r for r in rows if r.lang == lang and r.fold == fold]
            if not dev:
                continue
            top = commonest(r.y for r in train)
            least = min(r.y for r in train)
            of = lambda s, train=train, least=least: commonest(ys) if (ys := [r.y for r in train if r.source == s]) else least
            for name, pairs in (("majority", [(r.y, top) for r in dev]), ("conditional", [(r.y, of(r.source)) for r in dev])):
                assert abs(got[name, lang, fold, "accuracy"] - sum(y == p for y, p in pairs) / len(pairs)) < 1e-9
                assert abs(got[name, lang, fold, "macro_f1"] - macro_f1(pairs)) < 1e-9


def test_logistic_grid_chooses_the_best_strength(spark, sf_dir):
    grid = sorted((r.c, r.macro_f1, r.chosen) for r in entry.queries()["logreg_grid"](spark, sf_dir).collect())
    best = max(s for _, s, _ in grid)
    assert [c for c, _, chosen in grid if chosen] == [next(c for c, s, _ in grid if s == best)] and 0 <= best <= 1
