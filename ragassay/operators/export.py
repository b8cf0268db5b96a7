"""Which jobs to export, and the rows of the evaluation CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.functions.numbers import fixed_text
from ragassay.functions.prompts import none_text
from ragassay.schemas import EXPORT_HEADER


def case1_job(pivot: DataFrame) -> DataFrame:
    """Largest job id that has a correctness score."""
    return (
        pivot.filter("correctness_score IS NOT NULL")
        .agg(F.max("job_id").alias("job_id"))
        .filter("job_id IS NOT NULL")
    )


def latest_job_of_run(jobs: DataFrame) -> DataFrame:
    """Newest job per run."""
    return (
        jobs.filter("inference_run_id IS NOT NULL")
        .groupBy("inference_run_id")
        .agg(F.max_by("job_id", F.struct("start_time", "job_id")).alias("job_id"))
    )


def best_covered_job(pivot: DataFrame) -> DataFrame:
    """Job with the most rows that have a faithfulness score."""
    counted = (
        pivot.filter("faithfulness_score IS NOT NULL")
        .groupBy("job_id")
        .agg(F.count("query_id").alias("scored"))
    )
    return counted.orderBy(F.desc("scored"), "job_id").limit(1)


def case2_job(jobs: DataFrame, pivot: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest job of each wanted run, else the best covered job of all."""
    fallback = best_covered_job(pivot).select("job_id")
    wanted = runs.select(F.col("run_id").alias("inference_run_id")).distinct()
    return (
        wanted.join(latest_job_of_run(jobs), "inference_run_id", "left")
        .select(
            F.col("inference_run_id").alias("run_id"),
            F.coalesce(F.col("job_id"), fallback.scalar()).alias("job_id"),
        )
        .filter("job_id IS NOT NULL")
    )


def export_rows(pivot: DataFrame) -> DataFrame:
    """Rows of the CSV: two-place scores, empty text for missing values.

    A missing answer prints ``None``, a missing ground truth prints nothing.
    """

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    def score(metric: str) -> list[Column]:
        value = F.col(f"{metric}_score")
        return [
            F.when(value.isNull(), "").otherwise(fixed_text(value, 2)).alias(f"{metric}_score"),
            blank(f"{metric}_reasoning").alias(f"{metric}_reasoning"),
        ]

    contexts = F.col("retrieved_contexts")
    nested = pivot.schema["retrieved_contexts"].dataType.typeName() != "string"
    shown = F.to_json(contexts) if nested else contexts
    return pivot.select(
        "job_id",
        F.col("query_id").cast("string").alias("query_id"),
        none_text(F.col("question")).alias("question"),
        F.coalesce(shown, F.lit("")).alias("retrieved_contexts"),
        none_text(F.col("generated_answer")).alias("generated_answer"),
        blank("ground_truth").alias("ground_truth"),
        *score("context_relevance"),
        *score("faithfulness"),
        *score("answer_relevance"),
        *score("correctness"),
    )


def with_header(rows: DataFrame) -> DataFrame:
    """Same rows under the column titles of the CSV file."""
    titled = rows.drop("job_id")
    return titled.toDF(*EXPORT_HEADER)
