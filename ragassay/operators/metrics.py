"""Wide view of the long metric table, averages per job, job metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.functions.numbers import exact_mean, half_even
from ragassay.operators.evaluate import ground_truths
from ragassay.operators.retrieve import active
from ragassay.schemas import BLIND_DATASET, METRICS, NOT_FOUND, UNKNOWN_RUN


def of_jobs(rows: DataFrame, jobs: DataFrame | None) -> DataFrame:
    """Rows of the given jobs, all of them by default."""
    return rows if jobs is None else rows.join(jobs.select("job_id").distinct(), "job_id", "left_semi")


def metrics_pivot(
    metrics: DataFrame,
    history: DataFrame,
    golden_mapping: DataFrame,
    golden: DataFrame,
    jobs: DataFrame | None = None,
) -> DataFrame:
    """One row per job, query and distinct ground truth, five metrics wide.

    With ``jobs`` the metrics of other jobs leave before anything is grouped. Value and
    reasoning are separate maxima. The long table is reduced to (job, query) before any
    join: joined columns depend on the query alone. Ground truths are told apart by
    their digests, the texts join afterwards.
    """
    wanted = []
    for name in METRICS:
        mine = F.col("metric_name") == name
        wanted += [
            F.max(F.when(mine, F.col("metric_value"))).alias(f"{name}_score"),
            F.max(F.when(mine, F.col("reasoning"))).alias(f"{name}_reasoning"),
        ]
    scored = of_jobs(active(metrics), jobs).groupBy("job_id", "query_id").agg(*wanted)
    carried = [
        c
        for c in ("question", "generated_answer", "retrieved_contexts")
        if c in history.columns
    ]
    asked = active(history).select("query_id", *carried)
    digests = golden.withColumn("ground_truth", F.md5("ground_truth"))
    links = ground_truths(golden_mapping, digests)
    one_each = links.groupBy("query_id", "ground_truth").agg(
        F.min("golden_record_id").alias("golden_record_id")
    )
    texts = active(golden).select(F.col("id").alias("golden_record_id"), "ground_truth")
    truths = one_each.drop("ground_truth").join(texts, "golden_record_id", "left")
    return scored.join(asked, "query_id").join(truths.drop("golden_record_id"), "query_id", "left")


def metric_averages(pivot: DataFrame, jobs: DataFrame) -> DataFrame:
    """Mean of each score per requested job; nothing scored means 0.0."""
    means = pivot.groupBy("job_id").agg(
        *[exact_mean(F.col(f"{name}_score")).alias(name) for name in METRICS]
    )
    asked = jobs.select("job_id").distinct()
    return asked.join(means, "job_id", "left").select(
        "job_id", *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in METRICS]
    )


def job_metadata(
    jobs: DataFrame,
    run_mapping: DataFrame,
    golden_mapping: DataFrame,
    golden: DataFrame,
    requested: DataFrame,
) -> DataFrame:
    """Run id and data set name of each requested job.

    The largest batch name is found per run first, so a run evaluated by many
    jobs is walked once. Soft deletes play no part here.
    """
    names = golden.select(F.col("id").alias("golden_record_id"), "batch_name")
    # batch names per query, then per run: both are partial aggregates
    per_query = (
        golden_mapping.select("query_id", "golden_record_id")
        .join(names, "golden_record_id")
        .groupBy("query_id")
        .agg(F.max("batch_name").alias("batch_name"))
    )
    per_run = (
        run_mapping.select(F.col("run_id").alias("inference_run_id"), "query_id")
        .join(per_query, "query_id")
        .groupBy("inference_run_id")
        .agg(F.max("batch_name").alias("batch_name"))
    )
    known = jobs.select("job_id", "inference_run_id", F.lit(True).alias("_known")).join(
        per_run, "inference_run_id", "left"
    )
    asked = requested.select("job_id").distinct().join(known, "job_id", "left")

    def or_not_found(value: Column, default: str) -> Column:
        return F.when(F.col("_known"), F.coalesce(value, F.lit(default))).otherwise(NOT_FOUND)

    return asked.select(
        "job_id",
        or_not_found(F.col("inference_run_id").cast("string"), UNKNOWN_RUN).alias("setting_id"),
        or_not_found(F.nullif(F.col("batch_name"), F.lit("")), BLIND_DATASET).alias("dataset_name"),
    )


def overall_quality(averages: DataFrame) -> DataFrame:
    """Mean of the averages above zero, two places; none gives 0.0."""
    scored = F.filter(F.array(*METRICS), lambda v: v > 0)
    total = F.aggregate(scored, F.lit(0.0), lambda acc, v: acc + v)
    mean = half_even(total / F.size(scored), 2)
    return averages.withColumn("quality_score", F.when(F.size(scored) > 0, mean).otherwise(0.0))
