"""The corpus pipeline against a run of its stages' rules by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewarden.llm import pii, simhash, toxicity


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs = [spark.read.parquet(f"{small}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs[-1], small).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_of_documents(stages):
    for before, after in itertools.pairwise(stages[:-1]):
        assert after.columns == before.columns and ids(after) <= ids(before)


def test_rejected_documents_go(spark, small, stages):
    scores = toxicity.toxicity(stages[0], spark.read.parquet(f"{small}/labels.parquet"))
    assert ids(stages[1]) == ids(scores.where("predicted = 0"))


def test_one_of_each_group_stays(stages):
    prints = {r["doc_id"]: simhash.fingerprint_of(r["text"]) for r in stages[1].select("doc_id", "text").collect()}
    kept = ids(stages[2])
    assert all((prints[a] ^ prints[b]).bit_count() > 3 for a, b in itertools.combinations(kept, 2))
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(stages[1]).collect()}
    assert kept == set(groups.values())


def test_benchmark_passages_go(spark, small, stages):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [__import__("re").findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)}
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    held = {r["doc_id"] for r in stages[2].collect() for own in [shingles(r["text"])] if any(len(own & i) >= 0.8 * len(i) for i in items)}
    assert ids(stages[3]) == ids(stages[2]) - held


def test_personal_data_is_masked(stages):
    assert ids(stages[4]) == ids(stages[3])
    assert all(pii.base_spans(r["text"]) == [] for r in stages[4].select("text").collect())
    assert stages[4].where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_every_document_is_packed(stages):
    assert ids(stages[5]) == ids(stages[4])
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_is_the_stages_in_a_row(spark, small, stages):
    assert corpus_pipeline.run(spark, small).count() == stages[5].count()
