"""The corpus pipeline: each stage against a plain version on its own input, and the whole run."""

from __future__ import annotations

import pytest

import corpus_pipeline
from palimpsest.llm import linededup, toxicity
from palimpsest.llm.common import materialize
from tests.llm.test_set_operators import brute_components, check_packing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir))
        out[name] = (before, docs)
    return out


def test_columns(stages, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [d.columns == columns for _, d in stages.values()] == [True, True, True, True, False]


def test_toxicity_stage(stages, spark, sf_dir):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = {r["doc_id"] for r in toxicity.toxicity(before, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in after.collect()} == clean


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    cut = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(before).collect()}
    got = {r["doc_id"]: r for r in after.collect()}
    assert all(r["text"] == cut[i] for i, r in got.items())
    assert all(not cut[i].strip() for i in set(cut) - set(got))


def test_near_duplicate_stage(stages):
    before, after = stages["ngram_jaccard"]
    component = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, c in component.items() if i == c}


def test_mixing_stage(stages):
    before, after = stages["source_mixing"]
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert after.count() == after.select("doc_id").distinct().count()
    assert 0.8 * words(before) <= words(after) <= 0.9 * words(before)


def test_packing_stage(stages):
    before, after = stages["best_fit_packing"]
    found = after.toPandas()
    check_packing(found, 1024)
    assert set(found["doc_id"]) == {r["doc_id"] for r in before.collect()}


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["best_fit_packing"][1].count()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_edges(name, stage, spark, sf_dir, docs, clashing, empty):
    assert stage(spark, empty, sf_dir).count() == 0
    assert 0 < stage(spark, docs, sf_dir).count() <= 400
    got = stage(spark, clashing, sf_dir)
    assert name == "best_fit_packing" or got.columns == clashing.columns
    assert got.count() > 0
