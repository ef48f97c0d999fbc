import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import decontamination as dc
from cohortlens.llm import near_duplicates as nd
from cohortlens.llm import packing, repeated_passages, toxicity
from cohortlens.llm.common import read

NAMES = ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows that each stage returns, from those of the one before."""
    docs = read(spark, sf_dir, "documents")
    at = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = at[name] = spark.createDataFrame(docs.collect(), docs.schema)
    return at


def test_stages_keep_columns_and_their_decisions_take_effect(spark, sf_dir, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    before = stages["documents"]
    for name in NAMES[:-1]:
        assert stages[name].columns == before.columns and stages[name].dtypes == before.dtypes
        assert 0 < stages[name].count() <= before.count()
    assert nd.near_duplicate_components(stages["near_dedup"]).where("doc_id <> component_id").count() == 0
    assert stages["near_dedup"].count() == nd.near_duplicate_components(stages["toxicity"]).select("component_id").distinct().count()
    assert repeated_passages.remove_repeats(stages["suffix_dedup"]).agg({"n_removed": "sum"}).first()[0] < 0.02 * sum(len(r.text) for r in stages["suffix_dedup"].collect())
    assert dc.contaminated(stages["decontamination"], read(spark, sf_dir, "benchmark")).where("contaminated").count() == 0
    assert {r.doc_id for r in stages["packing"].collect()} == {r.doc_id for r in stages["decontamination"].collect()}


def test_kept_rows_equal_plain_decisions(spark, sf_dir, stages):
    """Each stage against a plain version of its decision: scores of the model, all pairs' components, a scan of the bytes, every passage."""
    from tests.llm.test_operators import plain_components, plain_fingerprint, plain_passages, plain_removal

    model = corpus_pipeline.toxicity_model(spark, sf_dir)
    docs = [(r.doc_id, r.text or "") for r in stages["documents"].collect()]
    ids = lambda name: sorted(r.doc_id for r in stages[name].collect())
    assert ids("toxicity") == sorted(i for i, t in docs if model.scores([t])[0] < 0.3)
    rows = [(r.doc_id, r.text or "") for r in stages["toxicity"].collect()]
    roots = plain_components({plain_fingerprint(t.encode()) for _, t in rows})
    first = {}
    for i, t in rows:
        root = roots[plain_fingerprint(t.encode())]
        first[root] = min(i, first.get(root, i))
    assert ids("near_dedup") == sorted(first.values())
    rows = [(r.doc_id, (r.text or "").encode()) for r in stages["near_dedup"].collect()]
    left = {i: n - gone for i, n, gone, _, _ in plain_removal(rows, 50) if gone < n or not n}
    assert ids("suffix_dedup") == sorted(left)
    bench = [dc.word_hashes((r.text or "").encode()) for r in read(spark, sf_dir, "benchmark").collect()]
    kept = set(ids("decontamination"))
    for r in stages["suffix_dedup"].collect():
        words = dc.word_hashes((r.text or "").encode())
        found = any(plain_passages(words, b) for b in bench if len(b) and not set(b.tolist()).isdisjoint(words.tolist()))
        assert found == (r.doc_id not in kept)
    want = {r.doc_id: len(re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())) + 1 for r in stages["decontamination"].collect()}
    assert {r.doc_id: r.n for r in stages["packing"].groupBy("doc_id").agg(F.sum("piece_len").alias("n")).collect()} == want


def test_run_gives_the_stages_result(spark, sf_dir, stages):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == stages["packing"].columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, stages["packing"].collect()))


def test_stages_take_nulls_repeats_other_columns_and_empty_tables(spark, sf_dir):
    clean = [r.text for r in read(spark, sf_dir, "documents").where("doc_id < 40").collect()]
    rows = [(1, None), (2, ""), (None, "no id and few words here"), (None, None), (5, clean[3]), (5, clean[3]), (5, clean[4]), (6, clean[5] * 200), (7, " \n ")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("score", "key", "fp", "n_bytes", "__same", "contaminated")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() >= {"toxicity": 3, "near_dedup": 3, "suffix_dedup": 8, "decontamination": 5, "packing": 9}[name]
    assert isinstance(toxicity.train([]), toxicity.Model) and packing.pack(docs.limit(0)).count() == 0
