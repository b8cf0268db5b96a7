"""The whole life of a corpus: ingest, benchmark, answer, evaluate, diagnose, export."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from ragassay.functions.embedding import hashing_embedder
from ragassay.operators import metrics
from ragassay.plans.answering import answer_questions, run_inference
from ragassay.plans.benchmark import build_benchmark
from ragassay.plans.diagnosis import diagnose_jobs, stored_pivot
from ragassay.plans.evaluation import evaluate_runs
from ragassay.plans.exporting import export_evaluations
from ragassay.plans.ingestion import ingest_documents
from ragassay.schemas import METRICS, NO_ANSWER
from ragassay.session import checkpoint_folder
from ragassay.sources import sinks, store

EMBED = hashing_embedder(64)
DOC = "document_name string, file_path string, md5_hash string, total_pages int, pages array<string>, topics array<string>"


def text(subject, n=60):
    return ". ".join(f"The {subject} report states that item {i} of {subject} grew" for i in range(n)) + "."


def documents(spark, *rows):
    full = [(name, f"/in/{path}", f"md5-{path}", len(pages), pages, topics) for name, path, pages, topics in rows]
    return spark.createDataFrame(full, DOC)


def stats_of(df):
    return {r.doc_name: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    first = documents(
        spark,
        ("a.pdf", "1/a.pdf", [text("income"), " ", text("risk")], ["Finance", "Risk"]),
        ("b.pdf", "1/b.pdf", [text("climate")], ["Climate"]),
        ("empty.pdf", "1/e.pdf", ["  "], ["Nothing"]),
    )
    return root, stats_of(ingest_documents(spark, root, first, embed=EMBED))


def test_first_load(spark, loaded):
    root, stats = loaded
    assert set(stats) == {"a.pdf", "b.pdf"}
    assert stats["a.pdf"]["inserted_topics"] == 2 and stats["a.pdf"]["soft_deleted_documents"] == 0
    chunks = store.read(spark, root, "document_chunks", 1)
    assert chunks.count() == sum(s["inserted_document_chunks"] for s in stats.values())
    assert chunks.filter("size(embedding) <> 64 OR is_deleted").count() == 0
    assert store.read(spark, root, "topics", 1).count() == 3


def test_second_version_retires_the_first(spark, loaded):
    root, _ = loaded
    before = store.read(spark, root, "document_chunks", 1).count()
    second = documents(
        spark,
        ("a.pdf", "2/a.pdf", [text("dividend")], ["Finance"]),
        ("a.pdf", "3/a.pdf", [text("capital")], ["Finance", "Capital"]),
    )
    stats = stats_of(ingest_documents(spark, root, second, embed=EMBED))["a.pdf"]
    version = store.current_version(spark, root)
    docs = store.read(spark, root, "documents", version).filter("doc_name = 'a.pdf'")
    assert {r.metadata.file_path: r.is_deleted for r in docs.collect()} == {
        "/in/1/a.pdf": True, "/in/2/a.pdf": True, "/in/3/a.pdf": False,
    }
    assert stats["soft_deleted_documents"] == 2 and stats["inserted_documents"] == 2
    assert stats["inserted_topics"] == 1 and stats["soft_deleted_document_topics"] == 3
    chunks = store.read(spark, root, "document_chunks", version)
    assert chunks.filter("is_deleted").count() == stats["soft_deleted_document_chunks"]
    # the older version is still readable as it was
    assert store.read(spark, root, "document_chunks", 1).filter("NOT is_deleted").count() == before


def test_nothing_shows_before_its_version(spark, loaded):
    root, _ = loaded
    version = store.current_version(spark, root)
    before = store.read(spark, root, "topics").count()
    store.write_part(spark.createDataFrame([("x", "y")], "topic_id string, topic_name string"), root, "topics", "t")
    assert store.read(spark, root, "topics").count() == before
    with pytest.raises(FileExistsError):
        store.publish(spark, root, version - 1, append={})


def test_what_a_failed_writer_left_gives_way(spark, folder):
    os.makedirs(f"{folder}/versions/version=1/_temporary")
    assert store.current_version(spark, folder) == 0
    row = spark.createDataFrame([("x", "y")], "topic_id string, topic_name string")
    store.write_part(row, folder, "topics", "failed")
    load = store.write_part(row, folder, "topics", "t")
    assert store.publish(spark, folder, 0, append={"topics": [load]}) == 1
    assert store.current_version(spark, folder) == 1
    assert [r.created_by for r in store.read(spark, folder, "topics").collect()] == ["t"]
    # two writers that start from one version: the second one fails and leaves nothing
    again = store.write_part(row, folder, "topics", "u")
    assert store.publish(spark, folder, 1, append={"topics": [again]}) == 2
    with pytest.raises(FileExistsError):
        store.publish(spark, folder, 1, append={"topics": [store.write_part(row, folder, "topics", "v")]})
    assert sorted(r.created_by for r in store.read(spark, folder, "topics").collect()) == ["t", "u"]
    assert [r.created_by for r in store.read(spark, folder, "topics", 1).collect()] == ["t"]
    assert sorted(n for n in os.listdir(f"{folder}/versions") if n[0] == "v") == ["version=1", "version=2"]


def test_a_table_that_starts_anew(spark, folder):
    loads = [store.write_part(spark.createDataFrame([(n, n)], "topic_id string, topic_name string"), folder, "topics", "t") for n in "abc"]
    store.publish(spark, folder, 0, append={"topics": loads[:1]})
    store.publish(spark, folder, 1, replace={"topics": loads[1:2]})
    store.publish(spark, folder, 2, append={"topics": loads[2:]})
    store.publish(spark, folder, 3, replace={"topics": []})
    names = [sorted(r.topic_id for r in store.read(spark, folder, "topics", v).collect()) for v in range(5)]
    assert names == [[], ["a"], ["b"], ["b", "c"], []]


def test_one_file_twice_in_a_batch(spark, folder):
    twice = documents(spark, *[("a.pdf", "a.pdf", [text("income")], ["Finance"])] * 2)
    stats = stats_of(ingest_documents(spark, folder, twice, embed=EMBED))["a.pdf"]
    assert (stats["inserted_documents"], stats["soft_deleted_documents"]) == (2, 1)
    docs = store.read(spark, folder, "documents").collect()
    assert len({r.doc_id for r in docs}) == 2 and sorted(r.is_deleted for r in docs) == [False, True]
    chunks = store.read(spark, folder, "document_chunks")
    assert chunks.select("id").distinct().count() == chunks.count()


def test_topics_may_be_missing_and_others_stay_untouched(spark, folder):
    first = documents(spark, ("a", "a", [text("income")], ["Finance"]), ("n", "n", [text("sea")], None))
    stats = stats_of(ingest_documents(spark, folder, first, embed=EMBED))
    assert stats["n"]["inserted_document_topics"] == 0
    before = {r.topic_name: r for r in store.read(spark, folder, "topics").collect()}
    second = documents(spark, ("b", "b", [text("risk")], ["Risk"])).drop("topics")
    ingest_documents(spark, folder, second, embed=EMBED)
    third = documents(spark, ("c", "c", [text("coal")], ["Coal"]))
    ingest_documents(spark, folder, third, embed=EMBED, by="someone")
    after = {r.topic_name: r for r in store.read(spark, folder, "topics").collect()}
    assert after["Finance"] == before["Finance"] and set(after) == {"Finance", "Coal"}
    ingest_documents(spark, folder, first.filter("document_name = 'a'"), embed=EMBED, by="again")
    again = {r.topic_name: r for r in store.read(spark, folder, "topics").collect()}
    assert again["Finance"].updated_by == "again" and again["Coal"] == after["Coal"]


def test_a_rebuilt_batch_has_new_records(spark, folder):
    docs = documents(spark, ("a", "a", [text("income")], ["Finance"]))
    ingest_documents(spark, folder, docs, embed=EMBED)
    build_benchmark(spark, folder, "b1", 3, seed=5)
    run_inference(spark, folder, "case1", batch_name="b1", run_id="old", embed=EMBED)
    assert [r.metrics_generated for r in evaluate_runs(spark, folder, ["old"]).collect()] == [3]
    build_benchmark(spark, folder, "b1", 3, seed=5, by="rebuild")
    golden = store.read(spark, folder, "golden_records").collect()
    assert len({r.id for r in golden}) == len(golden) == 6
    assert {r.updated_by for r in golden if r.is_deleted} == {"rebuild"}
    # the old run's records are retired: its queries are judged without a ground truth
    assert [r.metrics_generated for r in evaluate_runs(spark, folder, ["old"]).collect()] == [9]


def test_reports_of_other_jobs_stay(spark, folder):
    row = "job_id string, report_file string, report struct<quality_score:double>"
    one, two = ("j1", "f.json", (1.0,)), ("j2", "f.json", (2.0,))
    sinks.write_reports(spark.createDataFrame([one, two], row), f"{folder}/r")
    sinks.write_reports(spark.createDataFrame([("j1", "f.json", (3.0,))], row), f"{folder}/r")
    found = {p.split("job_id=")[1][:2]: json.load(open(p)) for p in glob.glob(f"{folder}/r/*/*/part-*")}
    assert found == {"j1": {"quality_score": 3.0}, "j2": {"quality_score": 2.0}}


def test_csv_keeps_blanks(spark, folder):
    names = [
        "job_id", "query_id", "question", "retrieved_contexts", "generated_answer", "ground_truth",
        *[f"{m}_{part}" for m in METRICS[:4] for part in ("score", "reasoning")],
    ]
    row = ["j", "q", "  padded  ", "", 'say "x" ', *[""] * (len(names) - 5)]
    rows = spark.createDataFrame([tuple(row)], ", ".join(f"{n} string" for n in names))
    sinks.write_evaluation_csv(rows.coalesce(1), f"{folder}/csv")
    (path,) = glob.glob(f"{folder}/csv/part-*")
    (got,) = csv.DictReader(open(path, newline=""))
    assert got["Question"] == "  padded  " and 'say "x" ' in got.values()


def test_answer_evaluate_diagnose_export(spark, loaded, folder):
    root, _ = loaded
    built = build_benchmark(spark, root, "benchmark_v1", 4, seed=5).first()
    assert (built.sampled, built.valid, built.yield_rate) == (4, 4, 100.0)
    build_benchmark(spark, root, "benchmark_v1", 3, topics=["Finance", "Climate"], seed=6)
    golden = store.read(spark, root, "golden_records")
    assert golden.filter("NOT is_deleted").count() == 3 and golden.count() == 7

    asked = spark.createDataFrame(
        [(0, "climate report item"), (1, "zebra xylophone quux"), (2, "capital report"), (3, "cut off")],
        "ordinal int, question string",
    )
    options = dict(embed=EMBED, threshold=0.2)
    one = run_inference(spark, root, "case1", batch_name="benchmark_v1", run_id="run-1", **options).first()
    assert tuple(one) == ("run-1", 1, 3, 3, 3)
    two = run_inference(spark, root, "case2", questions=asked, limit=3, run_id="run-2", **options).first()
    assert tuple(two) == ("run-2", 1, 3, 3, 0)
    assert run_inference(spark, root, "case1", batch_name="none", run_id="run-3", **options).count() == 0
    log = {r.question: r for r in store.read(spark, root, "query_history").collect()}
    assert all(r.query_time <= r.response_time for r in log.values())
    assert len({r.response_time for r in log.values()}) > 1
    assert log["zebra xylophone quux"].retrieved_contexts == []
    assert log["zebra xylophone quux"].generated_answer.startswith("I'm sorry")
    assert log["climate report item"].retrieved_contexts[0].text == log["climate report item"].generated_answer
    live = {r.doc_id for r in store.read(spark, root, "documents").filter("NOT is_deleted").collect()}
    assert {c.doc_id for r in log.values() for c in r.retrieved_contexts} <= live

    summary = evaluate_runs(spark, root).collect()
    assert sorted((r.total_queries_evaluated, r.metrics_generated) for r in summary) == [(3, 3), (3, 9)]
    jobs = store.read(spark, root, "evaluation_job_history")
    assert {r.inference_run_id for r in jobs.collect()} == {"run-1", "run-2"}
    scored = store.read(spark, root, "evaluation_metrics")
    assert {(r.evaluation_strategy, r["count"]) for r in scored.groupBy("evaluation_strategy").count().collect()} == {
        ("CASE1_GROUND_TRUTH", 3), ("CASE2_RAG_TRIAD", 9),
    }
    assert evaluate_runs(spark, root, ["no such run"]).count() == 0
    assert store.read(spark, root, "evaluation_job_history").count() == 2

    reports = diagnose_jobs(spark, root, f"{folder}/reports").collect()
    assert {r.report_file for r in reports} == {"case1_diagnosis_report.json", "case2_diagnosis_report.json"}
    (path,) = glob.glob(f"{folder}/reports/report_file=case1_diagnosis_report.json/*/part-*")
    report = json.load(open(path, encoding="utf-8"))
    assert report["setting_id"] == "run-1" and report["dataset_name"] == "benchmark_v1"
    assert report["stage_metrics"]["end_to_end"]["correctness"] > 0

    written = export_evaluations(spark, root, f"{folder}/csv", "run-2")
    assert set(written) == {"case1_benchmark_evaluation.csv", "case2_blind_test_evaluation.csv"}
    rows = []
    for path in glob.glob(f"{folder}/csv/case2_blind_test_evaluation.csv/part-*"):
        rows += csv.DictReader(open(path, encoding="utf-8", newline=""))
    assert len(rows) == 3 and rows[0]["Correctness Score"] == ""
    assert {r["Question"] for r in rows} == {"climate report item", "zebra xylophone quux", "capital report"}


def test_ad_hoc_questions_with_overrides(spark, loaded):
    root, _ = loaded
    asked = spark.createDataFrame(
        [("a", "climate report item", 1, 0.2, ["Climate"]), ("b", "climate report item", None, None, ["Risk"]), ("c", "climate report item", 2, 0.99, None)],
        "query_id string, question string, top_k int, similarity_threshold double, topic_filters array<string>",
    )
    version = store.current_version(spark, root)
    answers = answer_questions(spark, root, asked, version, embed=EMBED, threshold=0.5)
    got = {r.query_id: r for r in answers.collect()}
    assert len(got["a"].retrieved_contexts) == 1 and "climate" in got["a"].generated_answer
    # the only document about risk was retired by its second version
    assert got["b"].retrieved_contexts == [] and got["b"].generated_answer == NO_ANSWER
    assert got["c"].retrieved_contexts == []


def scans(df):
    """ReadSchema and PushedFilters of every file scan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return [line for line in text.splitlines() if "FileScan" in line]


def test_scans_of_stored_tables_are_pruned(spark, loaded):
    root, _ = loaded
    nothing = {}
    for table in ("evaluation_metrics", "query_history"):
        rows = spark.createDataFrame([], store.TABLES[table])
        nothing[table] = [store.write_part(rows, root, table, "t")]
    store.publish(spark, root, store.current_version(spark, root), append=nothing)
    pivot = stored_pivot(spark, root)

    (scan,) = [s for s in scans(pivot.filter("job_id = 'j'").select("query_id", "correctness_score")) if "metric_value" in s]
    assert "EqualTo(job_id,j)" in scan and "Not(EqualTo(is_deleted,true))" in scan
    assert "reasoning" not in scan

    jobs = store.read(spark, root, "evaluation_job_history")
    for scan in scans(metrics.metric_averages(pivot, jobs)):
        assert not any(text in scan for text in ("question", "generated_answer", "retrieved_contexts", "reasoning"))


def test_compaction_keeps_the_state(spark, loaded):
    root, _ = loaded

    def state():
        docs = store.read(spark, root, "documents").select("doc_id", "is_deleted", "updated_by")
        chunks = store.read(spark, root, "document_chunks").select("id", "is_deleted", F.size("embedding"))
        return sorted(map(tuple, docs.collect()), key=str), sorted(map(tuple, chunks.collect()))

    before = state()
    store.compact(spark, root)
    assert state() == before
    assert store.read(spark, root, store.RETIRED).isEmpty()


def test_checkpoint_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        assert checkpoint_folder(spark) == configured
