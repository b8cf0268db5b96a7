"""Judging, metric storage, pivot, averages, rules and reports."""

import json

import pytest
from pyspark.sql import functions as F

from ragassay.functions import prompts
from ragassay.functions.prompts import judge_context_block
from ragassay.operators import diagnose, evaluate, export, metrics
from ragassay.schemas import NO_CONTEXT

HISTORY = "query_id string, question string, generated_answer string, retrieved_contexts array<struct<text:string>>, is_deleted boolean"


@pytest.fixture(scope="module")
def run(spark):
    """One query with a ground truth, one without, one deleted, one half deleted."""
    return dict(
        run_mapping=spark.createDataFrame(
            [("r", "q1", False), ("r", "q2", False), ("r", "q3", False), ("r", "q4", True), ("r", "q5", False)],
            "run_id string, query_id string, is_deleted boolean",
        ),
        history=spark.createDataFrame(
            [
                ("q1", "Q1", "A1", [("C1",)], False),
                ("q2", "Q2", None, None, False),
                ("q3", "Q3", "A3", [], True),
                ("q4", "Q4", "A4", [], False),
                ("q5", "Q5", "A5", [("C5",)], False),
            ],
            HISTORY,
        ),
        golden_mapping=spark.createDataFrame(
            [("q1", "g1", True), ("q5", "g2", False), ("q5", "g3", False)],
            "query_id string, golden_record_id string, is_deleted boolean",
        ),
        golden=spark.createDataFrame(
            [("g1", "b1", "GT Case 1", False), ("g2", "b2", "GT 2", False), ("g3", "b2", "GT 3", True)],
            "id string, batch_name string, ground_truth string, is_deleted boolean",
        ),
    )


def test_fetch_splits_the_cases(run):
    rows = evaluate.fetch_for_evaluation(**run).collect()
    got = sorted((r.query_id, r.ground_truth or "", r.generated_answer) for r in rows)
    # a deleted mapping row still links, a deleted golden record gives a row without truth
    assert got == [("q1", "GT Case 1", "A1"), ("q2", "", ""), ("q5", "", "A5"), ("q5", "GT 2", "A5")]
    assert [r.retrieved_contexts for r in rows if r.query_id == "q2"] == [[]]
    assert tuple(evaluate.case_counts(evaluate.fetch_for_evaluation(**run)).first()) == ("r", 4, 2, 2)


def test_routing_gives_one_and_three_rows(spark):
    fetched = spark.createDataFrame(
        [("j", "q1", "Q", "the answer", "the answer", []), ("j", "q2", "who is it", None, "it is me", [("it is",)]), ("j", "q3", "", "", "x", [])],
        "job_id string, query_id string, question string, ground_truth string, generated_answer string, retrieved_contexts array<struct<text:string>>",
    )
    rows = evaluate.metric_rows(evaluate.default_judges(fetched), []).collect()
    got = {(r.query_id, r.evaluation_strategy, r.metric_name): float(r.metric_value) for r in rows}
    assert got == {
        ("q1", "CASE1_GROUND_TRUTH", "correctness"): 5.0,
        ("q2", "CASE2_RAG_TRIAD", "context_relevance"): 3.3333,
        ("q2", "CASE2_RAG_TRIAD", "faithfulness"): 3.3333,
        ("q2", "CASE2_RAG_TRIAD", "answer_relevance"): 3.3333,
        # an empty ground truth is a ground truth
        ("q3", "CASE1_GROUND_TRUTH", "correctness"): 0.0,
    }
    assert {r.metric_category for r in rows} == {"generation"}


def test_abstaining_answer_is_faithful(spark):
    fetched = spark.createDataFrame(
        [("q", "Q", None, "I cannot answer based on the context", [("other",)])],
        "query_id string, question string, ground_truth string, generated_answer string, retrieved_contexts array<struct<text:string>>",
    )
    scores = {s.metric_name: s.score for s in evaluate.judge_triad(fetched).first().scores}
    assert scores["faithfulness"] == 5.0


def test_ground_truth_judge_refuses_blind_rows(spark):
    blind = spark.createDataFrame(
        [("q9", "Q", None, "A")], "query_id string, question string, ground_truth string, generated_answer string"
    )
    with pytest.raises(Exception, match="no ground truth for query q9"):
        evaluate.judge_correctness(blind).collect()


def test_failing_scorer_loses_only_its_query(spark):
    fetched = spark.createDataFrame(
        [("j", "q1", "Q", "T", "good", []), ("j", "q2", "Q", "T", "bad", []), ("j", "q3", "Q", None, "good", [("ctx",)])],
        "job_id string, query_id string, question string, ground_truth string, generated_answer string, retrieved_contexts array<struct<text:string>>",
    )

    def correctness(question, truth, answer):
        if answer == "bad":
            raise RuntimeError("model error")
        return [("correctness", 4.5, "fine")]

    def triad(question, contexts, answer):
        assert contexts == "[Document 1]:\nctx"
        return [(m, 9.99999, "") for m in ("context_relevance", "faithfulness", "answer_relevance")][:2]

    rows = evaluate.metric_rows(evaluate.judged(fetched, correctness, triad), [])
    with pytest.raises(Exception):
        rows.collect()  # 9.99999 does not fit NUMERIC(5,4)
    ok = rows.filter("query_id <> 'q3'").collect()
    assert [(r.query_id, float(r.metric_value)) for r in ok] == [("q1", 4.5)]


def test_judge_context_block(spark):
    df = spark.createDataFrame([(1, [("a",), ("b",)]), (2, []), (3, [(None,)])], "i int, c array<struct<text:string>>")
    got = {r.i: r.b for r in df.select("i", judge_context_block(F.col("c")).alias("b")).collect()}
    assert got == {1: "[Document 1]:\na\n\n[Document 2]:\nb", 2: NO_CONTEXT, 3: "[Document 1]:\n"}


def test_task_names_inputs_and_fields(spark):
    df = spark.createDataFrame([("Q?", None)], "q string, t string")
    row = df.select(prompts.task(prompts.TRIAD_FIELDS, question=F.col("q"), contexts=F.col("t"))).first()
    assert row[0].startswith("<question>\nQ?\n</question>\n<contexts>\n\n</contexts>\n")
    assert all(f"\n{name} (" in row[0] for name in prompts.TRIAD_FIELDS)


def test_a_lone_judge_is_used(spark):
    rows = [("q1", "a", "T", "a"), ("q2", "a", None, "b")]
    fetched = spark.createDataFrame(rows, "query_id string, question string, ground_truth string, generated_answer string")
    fetched = fetched.withColumn("retrieved_contexts", F.array(F.struct(F.lit("a").alias("text"))))
    given = evaluate.judged(fetched, correctness=lambda *_: [("correctness", 1.25, "given")])
    got = {r.query_id: [(s.metric_name, s.score) for s in r.scores] for r in given.collect()}
    assert got["q1"] == [("correctness", 1.25)]
    assert [name for name, _ in got["q2"]] == list(prompts.TRIAD_FIELDS)


def test_metrics_of_other_jobs_leave_before_the_first_aggregate(spark):
    metric = spark.createDataFrame([], "job_id string, query_id string, metric_name string, metric_value decimal(5,4), reasoning string, is_deleted boolean")
    history = spark.createDataFrame([], "query_id string, is_deleted boolean")
    links = spark.createDataFrame([], "query_id string, golden_record_id string")
    golden = spark.createDataFrame([], "id string, ground_truth string, is_deleted boolean")
    jobs = spark.createDataFrame([("j",)], "job_id string")
    pivot = metrics.metrics_pivot(metric, history, links, golden, jobs)
    tree = pivot._jdf.queryExecution().analyzed().toString()
    assert "LeftSemi" in tree.split("Aggregate [job_id")[1]


METRIC_ROWS = "event_id int, query_id string, evaluation_strategy string, metric_name string, job_id string, metric_value decimal(5,4)"


def test_insert_if_absent(spark):
    from decimal import Decimal as D

    batch = spark.createDataFrame(
        [(1, "q", "s", "m", "j", D("1.0")), (2, "q", "s", "m", "j", D("2.0")), (3, "q", "s", "n", "j", D("3.0")), (4, "q", "s", "m", None, D("4.0")), (5, "q", "s", "m", None, D("5.0"))],
        METRIC_ROWS,
    )
    nothing = batch.limit(0)
    first = evaluate.insert_if_absent(nothing, batch, "event_id")
    assert sorted(r.event_id for r in first.collect()) == [1, 3, 4, 5]
    again = evaluate.insert_if_absent(first, batch.filter("job_id IS NOT NULL"), "event_id")
    assert again.count() == 0


def test_pivot_and_averages(spark, run):
    from decimal import Decimal as D

    rows = [
        ("j", "q1", "correctness", D("4.0"), "a"), ("j", "q1", "correctness", D("2.0"), "z"),
        ("j", "q2", "faithfulness", D("3.0"), "b"), ("j", "q5", "correctness", D("1.0"), "c"),
        ("j", "q3", "faithfulness", D("5.0"), "deleted query"), ("j", "nope", "faithfulness", D("5.0"), "dangling"),
    ]
    table = spark.createDataFrame(rows, "job_id string, query_id string, metric_name string, metric_value decimal(5,4), reasoning string").withColumn("is_deleted", F.lit(False))
    pivot = metrics.metrics_pivot(table, run["history"], run["golden_mapping"], run["golden"])
    got = sorted((r.query_id, r.ground_truth or "", r.correctness_score, r.correctness_reasoning) for r in pivot.collect())
    # value and reasoning are separate maxima; two golden records give two rows
    assert got == [
        ("q1", "GT Case 1", D("4.0000"), "z"), ("q2", "", None, None), ("q5", "", D("1.0000"), "c"), ("q5", "GT 2", D("1.0000"), "c"),
    ]
    jobs = spark.createDataFrame([("j",), ("unknown",)], "job_id string")
    averages = {r.job_id: (r.correctness, r.faithfulness, r.answer_relevance) for r in metrics.metric_averages(pivot, jobs).collect()}
    assert averages == {"j": (2.0, 3.0, 0.0), "unknown": (0.0, 0.0, 0.0)}
    assert [r.job_id for r in export.case1_job(pivot).collect()] == ["j"]


def test_averages_do_not_shuffle_texts(spark, run):
    table = spark.createDataFrame([], "job_id string, query_id string, metric_name string, metric_value decimal(5,4), reasoning string, is_deleted boolean")
    pivot = metrics.metrics_pivot(table, run["history"], run["golden_mapping"], run["golden"])
    plan = metrics.metric_averages(pivot, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "reasoning" not in plan.split("LogicalRDD")[0] and "SortAggregate" not in plan


def test_job_metadata(spark, run):
    jobs = spark.createDataFrame([("j1", "r"), ("j2", "blind"), ("j3", None)], "job_id string, inference_run_id string")
    asked = spark.createDataFrame([("j1",), ("j2",), ("j3",), ("j4",)], "job_id string")
    got = metrics.job_metadata(jobs, run["run_mapping"], run["golden_mapping"], run["golden"], asked).collect()
    assert {r.job_id: (r.setting_id, r.dataset_name) for r in got} == {
        "j1": ("r", "b2"), "j2": ("blind", "case2_blind_test_dataset"),
        "j3": ("UNKNOWN_RUN", "case2_blind_test_dataset"), "j4": ("NOT_FOUND", "NOT_FOUND"),
    }


def averages(spark, **scores):
    row = {m: float(scores.get(m, 0.0)) for m in metrics.METRICS}
    return spark.createDataFrame([("test-job-1", *row.values())], ["job_id", *row])


@pytest.mark.parametrize(
    "rule, scores, fires",
    [
        (lambda: diagnose.retrieval_rule(3.5), dict(context_relevance=2.0), True),
        (lambda: diagnose.retrieval_rule(3.5), dict(context_relevance=4.0), False),
        (lambda: diagnose.retrieval_rule(3.5), dict(context_relevance=0.0), False),
        (lambda: diagnose.hallucination_rule(4.0), dict(faithfulness=3.1), True),
        (lambda: diagnose.answer_relevance_rule(), dict(context_relevance=4.0, answer_relevance=2.0), True),
        (lambda: diagnose.answer_relevance_rule(), dict(context_relevance=2.0, answer_relevance=2.0), False),
        (lambda: diagnose.answer_relevance_rule(), dict(context_relevance=4.0, answer_relevance=4.5), False),
        (lambda: diagnose.correctness_rule(4.0), dict(correctness=3.5), True),
        (lambda: diagnose.correctness_rule(4.0), dict(correctness=4.0), False),
    ],
)
def test_rules(spark, rule, scores, fires):
    found = diagnose.findings(diagnose.diagnosed(averages(spark, **scores), [rule()])).collect()
    assert bool(found) == fires


def test_findings_in_rule_order(spark):
    rules = [diagnose.retrieval_rule(), diagnose.hallucination_rule(), diagnose.correctness_rule()]
    df = averages(spark, context_relevance=2.0, faithfulness=1.5, correctness=2.5)
    found = diagnose.findings(diagnose.diagnosed(df, rules)).orderBy("finding_no").collect()
    assert [r.issue for r in found] == [
        "Low Retrieval Quality", "High Generator Hallucination", "Low Accuracy against Benchmark Ground Truth",
    ]
    assert found[0].evidence == ["avg_context_relevance (2.00) is below the acceptable threshold of 3.5."]


def test_quality_rounds_half_even(spark):
    df = averages(spark, context_relevance=3.2, faithfulness=4.8, answer_relevance=3.0, correctness=3.5)
    assert metrics.overall_quality(df).first().quality_score == 3.62
    assert metrics.overall_quality(averages(spark)).first().quality_score == 0.0


@pytest.mark.parametrize(
    "scores, dataset, file, quality",
    [
        (dict(correctness=4.270833333333333), "benchmark_2025_v1", "case1_diagnosis_report.json", 4.27),
        (
            dict(context_relevance=4.883333333333333, faithfulness=4.933333333333334, answer_relevance=5.0),
            "case2_blind_test_dataset", "case2_diagnosis_report.json", 4.94,
        ),
    ],
)
def test_published_reports(spark, scores, dataset, file, quality):
    metadata = spark.createDataFrame([("test-job-1", "run", dataset)], "job_id string, setting_id string, dataset_name string")
    row = diagnose.reports(averages(spark, **scores), metadata, diagnose.standard_rules()).select(
        "report_file", F.to_json("report").alias("j")
    ).first()
    report = json.loads(row.j)
    assert row.report_file == file
    assert list(report) == ["setting_id", "dataset_name", "overall_summary", "stage_metrics", "diagnosis"]
    assert report["overall_summary"] == {"quality_score": quality, "latency_seconds": 1.25, "cost_estimate": 0.05}
    assert report["stage_metrics"]["reranking"] == {} and report["diagnosis"] == []
    assert report["stage_metrics"]["end_to_end"]["correctness"] == scores.get("correctness", 0.0)


def test_report_file_and_missing_scores(spark):
    metadata = spark.createDataFrame([("test-job-1", "run", "other")], "job_id string, setting_id string, dataset_name string")
    rows = diagnose.reports(averages(spark, correctness=1.0), metadata, []).collect()
    assert [r.report_file for r in rows] == ["diagnosis_report_test-job.json"]
    assert diagnose.reports(averages(spark), metadata, []).count() == 0


def test_export_row_text(spark):
    from decimal import Decimal as D

    cols = "job_id string, query_id string, question string, generated_answer string, retrieved_contexts array<struct<text:string>>, ground_truth string"
    for m in metrics.METRICS:
        cols += f", {m}_score decimal(5,4), {m}_reasoning string"
    row = ("j", "q", "Q", None, None, None, D("2.6750"), "r") + (None, None) * 4
    got = export.with_header(export.export_rows(spark.createDataFrame([row], cols))).first().asDict()
    assert got["Generated Answer"] == "None" and got["Golden Answer (Ground Truth)"] == ""
    assert got["Context Relevance Score"] == "2.68" and got["Faithfulness Score"] == ""
    assert len(got) == 13
