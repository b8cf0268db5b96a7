"""Questions answered through the kept indexes of a corpus folder."""

import os

import pytest
from test_plans import EMBED, documents, text

from ragassay.plans.answering import answer_questions, run_inference
from ragassay.plans.evaluation import evaluate_runs
from ragassay.plans.ingestion import ingest_documents
from ragassay.schemas import NO_ANSWER
from ragassay.sources import store


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("indexed"))
    names = ["income", "risk", "climate", "capital", "coal", "tide"]
    ingest_documents(spark, root, documents(spark, *[(n, n, [text(n, 30)], [n]) for n in names]), embed=EMBED)
    ingest_documents(spark, root, documents(spark, ("risk", "risk2", [text("hazard", 30)], ["risk"])), embed=EMBED)
    return root


@pytest.mark.parametrize("indexing", ["bm25", "hybrid", "ivf"])
def test_searches_find_their_document(spark, loaded, indexing):
    version = store.current_version(spark, loaded)
    asked = spark.createDataFrame([("a", "climate report item"), ("b", "coal report item"), ("c", "zzz qqq"), ("d", "risk report item")], "query_id string, question string")
    options = dict(embed=EMBED, top_k=3, threshold=0.2, indexing=indexing)
    got = {r.query_id: r for r in answer_questions(spark, loaded, asked, version, **options).collect()}
    assert set(got) == set("abcd")
    assert "climate" in got["a"].generated_answer and "coal" in got["b"].generated_answer
    assert all(len(got[q].retrieved_contexts) == 3 for q in "ab")
    if indexing == "bm25":  # hashed vectors of unknown words may be near something
        assert got["c"].retrieved_contexts == [] and got["c"].generated_answer == NO_ANSWER
    # the first version of this document is retired
    live = {r.doc_id for r in store.read(spark, loaded, "documents").filter("NOT is_deleted").collect()}
    assert {c.doc_id for r in got.values() for c in r.retrieved_contexts} <= live
    # the second search opens what the first one built
    folders = [f"{loaded}/indexes/{n}/v{version}" for n in ("bm25", "ivf") if os.path.exists(f"{loaded}/indexes/{n}/v{version}")]
    before = {f: os.stat(f).st_mtime_ns for f in folders}
    again = {r.query_id: r.retrieved_contexts for r in answer_questions(spark, loaded, asked, version, **options).collect()}
    assert again == {q: r.retrieved_contexts for q, r in got.items()}
    assert before and before == {f: os.stat(f).st_mtime_ns for f in folders}


def test_runs_record_their_search(spark, loaded):
    asked = spark.createDataFrame([(0, "climate report item")], "ordinal int, question string")
    run_inference(spark, loaded, "case2", questions=asked, run_id="words", embed=EMBED, indexing="bm25")
    run = store.read(spark, loaded, "inference_run_history").filter("run_id = 'words'").first()
    assert run.indexing_config == "bm25"
    assert [r.metrics_generated for r in evaluate_runs(spark, loaded, ["words"]).collect()] == [3]


def test_what_the_indexes_cannot_do(spark, loaded):
    version = store.current_version(spark, loaded)
    asked = spark.createDataFrame([("a", "q", 2)], "query_id string, question string, top_k int")
    with pytest.raises(ValueError, match="overrides"):
        answer_questions(spark, loaded, asked, version, embed=EMBED, indexing="bm25")
    with pytest.raises(ValueError, match="one of"):
        answer_questions(spark, loaded, asked, version, embed=EMBED, indexing="other")


def test_similarity_reaches_the_averages(spark, loaded):
    from ragassay.operators import metrics
    from ragassay.plans.benchmark import build_benchmark
    from ragassay.plans.diagnosis import stored_pivot

    build_benchmark(spark, loaded, "b1", 3, seed=5)
    run_inference(spark, loaded, "case1", batch_name="b1", run_id="truths", embed=EMBED, indexing="hybrid", threshold=0.1)
    (summary,) = evaluate_runs(spark, loaded, ["truths"], similarity=EMBED).collect()
    assert summary.metrics_generated == 6
    jobs = store.read(spark, loaded, "evaluation_job_history").filter("inference_run_id = 'truths'")
    (row,) = metrics.metric_averages(stored_pivot(spark, loaded, jobs), jobs).collect()
    assert row.semantic_similarity > 0 and row.correctness > 0
