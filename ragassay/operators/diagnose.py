"""Threshold rules over metric averages and the report built from them.

A rule is a column: a finding struct where it fires, else null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.functions.arrays import exploded
from ragassay.functions.numbers import fixed_text
from ragassay.operators.metrics import overall_quality
from ragassay.schemas import METRICS


@dataclass(frozen=True)
class Finding:
    issue: str
    causes: tuple[str, ...]
    actions: tuple[str, ...]


# --- fixed values: wording of the findings, as it must appear in reports --------
RETRIEVAL = Finding(
    "Low Retrieval Quality",
    (
        "Chunk size too small causing semantic fragmentation.",
        "Dense embedding model lacks domain-specific vocabulary sensitivity.",
        "Top-K parameter is too restrictive to capture the necessary answer span.",
    ),
    (
        "Switch chunking strategy to 'recursive_section_aware' to preserve context boundaries.",
        "Upgrade indexing to 'hybrid_bm25_dense' to capture exact keyword matches alongside semantic meaning.",
        "Increase retrieval 'top_k' parameter from 5 to 10.",
    ),
)
HALLUCINATION = Finding(
    "High Generator Hallucination",
    (
        "LLM temperature is too high, encouraging creative divergence.",
        "System prompt lacks strict instructions forcing the LLM to rely solely on provided context.",
        "The LLM is relying on its internal parametric memory rather than the retrieved chunks.",
    ),
    (
        "Switch generation config to 'strict_citation_low_temp'.",
        "Lower LLM generation temperature to 0.0 or 0.1.",
        "Implement a post-generation self-correction LLM pass to verify citations.",
    ),
)
ANSWER_RELEVANCE = Finding(
    "Poor Answer Relevance despite Good Retrieval",
    (
        "The user's initial query was too vague or poorly phrased.",
        "The LLM was confused by 'semantic noise' (distracting information) present in the retrieved chunks.",
        "The LLM generator is too weak to synthesize a coherent answer from multiple distinct chunks.",
    ),
    (
        "Enable query_prompting strategy: 'query_rewrite' or 'step_back' to clarify the user's intent before retrieval.",
        "Inject a reranker (e.g., 'cross_encoder_miniLM') to aggressively filter out middle-ranked noise before generation.",
    ),
)
CORRECTNESS = Finding(
    "Low Accuracy against Benchmark Ground Truth",
    (
        "The system is failing on complex, multi-hop reasoning questions present in the benchmark dataset.",
        "Crucial information required by the Ground Truth is completely missing from the retrieval corpus.",
    ),
    (
        "Upgrade query_prompting strategy to 'decompose_then_merge' to handle complex multi-part questions.",
        "Verify that the necessary source documents for the benchmark batch are actually ingested in the database.",
    ),
)
LATENCY_SECONDS = 1.25
COST_ESTIMATE = 0.05


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _finding(fires: Column, finding: Finding, *evidence: Column) -> Column:
    return F.when(
        fires,
        F.struct(
            F.lit(finding.issue).alias("issue"),
            F.array(*evidence).alias("evidence"),
            _strings(finding.causes).alias("likely_root_causes"),
            _strings(finding.actions).alias("recommended_actions"),
        ),
    )


def _below(metric: str, threshold: float, finding: Finding) -> Column:
    score = F.col(metric)
    evidence = F.concat(
        F.lit(f"avg_{metric} ("),
        fixed_text(score, 2),
        F.lit(f") is below the acceptable threshold of {float(threshold)}."),
    )
    # a zero average means the metric was not computed
    return _finding((score != 0.0) & (score < threshold), finding, evidence)


def retrieval_rule(threshold: float = 3.5) -> Column:
    return _below("context_relevance", threshold, RETRIEVAL)


def hallucination_rule(threshold: float = 4.0) -> Column:
    return _below("faithfulness", threshold, HALLUCINATION)


def correctness_rule(threshold: float = 4.0) -> Column:
    return _below("correctness", threshold, CORRECTNESS)


def answer_relevance_rule(context_threshold: float = 3.5, answer_threshold: float = 3.5) -> Column:
    """Good contexts and still a poor answer."""
    context, answer = F.col("context_relevance"), F.col("answer_relevance")
    computed = (context != 0.0) & (answer != 0.0)
    return _finding(
        computed & (context >= context_threshold) & (answer < answer_threshold),
        ANSWER_RELEVANCE,
        F.concat(
            F.lit("avg_context_relevance ("),
            fixed_text(context, 2),
            F.lit(f") is healthy (>= {float(context_threshold)})."),
        ),
        F.concat(
            F.lit("However, avg_answer_relevance ("),
            fixed_text(answer, 2),
            F.lit(f") is poor (< {float(answer_threshold)})."),
        ),
    )


def standard_rules() -> list[Column]:
    """The rules of a diagnosis run, in order, with its stricter thresholds."""
    return [
        retrieval_rule(4.0),
        hallucination_rule(4.5),
        answer_relevance_rule(3.5, 3.5),
        correctness_rule(4.0),
    ]


def diagnosed(averages: DataFrame, rules: list[Column]) -> DataFrame:
    """Triggered findings per job, in rule order."""
    return averages.withColumn("diagnosis", F.filter(F.array(*rules), lambda f: f.isNotNull()))


def findings(diagnoses: DataFrame) -> DataFrame:
    """Long form: one row per job and finding."""
    return exploded(diagnoses, "diagnosis", ["job_id"], "f", "_pos").select(
        "job_id", (F.col("_pos") + 1).alias("finding_no"), "f.*"
    )


def stage_metrics() -> Column:
    """Averages grouped by pipeline stage; the reranking stage has no metrics."""
    return F.struct(
        F.struct("context_relevance").alias("retrieval"),
        F.expr("map()").cast("map<string,double>").alias("reranking"),
        F.struct("faithfulness", "answer_relevance").alias("generation"),
        F.struct("correctness", "semantic_similarity").alias("end_to_end"),
    )


# --- fixed value: the stage each metric is reported under -----------------------
STAGES = {
    "context_relevance": "retrieval",
    "faithfulness": "generation",
    "answer_relevance": "generation",
    "correctness": "end_to_end",
    "semantic_similarity": "end_to_end",
}


def stage_metrics_long(averages: DataFrame) -> DataFrame:
    pairs = [
        F.struct(
            F.lit(stage).alias("stage"), F.lit(metric).alias("metric_name"), F.col(metric).alias("value")
        )
        for metric, stage in STAGES.items()
    ]
    return averages.select("job_id", F.explode(F.array(*pairs)).alias("m")).select("job_id", "m.*")


# --- fixed values: data set marks and the report files they select --------------
CASE1_MARKS = ("hsbc", "benchmark")
CASE2_MARKS = ("blind", "case2")
CASE1_REPORT = "case1_diagnosis_report.json"
CASE2_REPORT = "case2_diagnosis_report.json"


def report_file(dataset_name: Column, job_id: Column) -> Column:
    """File name of a job's report; the first matching data set mark decides."""

    def has(marks: tuple[str, ...]) -> Column:
        return reduce(or_, (dataset_name.contains(mark) for mark in marks))

    own = F.concat(
        F.lit("diagnosis_report_"), F.substring(job_id.cast("string"), 1, 8), F.lit(".json")
    )
    return (
        F.when(has(CASE1_MARKS), CASE1_REPORT)
        .when(has(CASE2_MARKS), CASE2_REPORT)
        .otherwise(own)
    )


def reports(
    averages: DataFrame,
    metadata: DataFrame,
    rules: list[Column],
    measured: DataFrame | None = None,
) -> DataFrame:
    """One report struct per job; jobs without any score above or below zero have none.

    With ``measured`` (job_id, latency_seconds, cost_estimate) the summary has these in
    place of the settings' estimates, which stay where nothing was measured.
    """
    scored = averages.filter(F.exists(F.array(*METRICS), lambda v: v != 0.0))
    full = diagnosed(overall_quality(scored), rules).join(metadata, "job_id")
    latency, cost = F.lit(LATENCY_SECONDS), F.lit(COST_ESTIMATE)
    if measured is not None:
        full = full.join(measured, "job_id", "left")
        latency, cost = F.coalesce("latency_seconds", latency), F.coalesce("cost_estimate", cost)
    report = F.struct(
        "setting_id",
        "dataset_name",
        F.struct(
            "quality_score",
            latency.alias("latency_seconds"),
            cost.alias("cost_estimate"),
        ).alias("overall_summary"),
        stage_metrics().alias("stage_metrics"),
        "diagnosis",
    )
    return full.select(
        "job_id",
        report_file(F.col("dataset_name"), F.col("job_id")).alias("report_file"),
        report.alias("report"),
    )
