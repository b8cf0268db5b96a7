"""Reports for evaluation jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ragassay.operators import diagnose, latency, metrics
from ragassay.operators.retrieve import active
from ragassay.sources import sinks, store


def stored_pivot(spark: SparkSession, root: str, jobs: DataFrame | None = None) -> DataFrame:
    version = store.current_version(spark, root)

    def table(name: str) -> DataFrame:
        return store.read(spark, root, name, version)

    return metrics.metrics_pivot(
        table("evaluation_metrics"),
        table("query_history"),
        table("golden_record_query_mapping"),
        table("golden_records"),
        jobs,
    )


def build_reports(
    spark: SparkSession,
    root: str,
    jobs: DataFrame | None = None,
    rules: list[Column] | None = None,
    measured: bool = False,
) -> DataFrame:
    """(job_id, report_file, report) for the asked jobs, by default all of them.

    ``measured`` reports the median latency and the cost per query of the job's run.
    """
    version = store.current_version(spark, root)
    history = store.read(spark, root, "evaluation_job_history", version)
    asked = history if jobs is None else jobs
    averages = metrics.metric_averages(stored_pivot(spark, root, jobs), asked)
    metadata = metrics.job_metadata(
        history,
        store.read(spark, root, "inference_run_query_mapping", version),
        store.read(spark, root, "golden_record_query_mapping", version),
        store.read(spark, root, "golden_records", version),
        asked,
    )
    times = None
    if measured:
        runs = active(store.read(spark, root, "inference_run_query_mapping", version))
        logged = active(store.read(spark, root, "query_history", version))
        times = latency.job_latencies(history, latency.run_sketches(runs, logged))
    return diagnose.reports(averages, metadata, rules or diagnose.standard_rules(), times)


def diagnose_jobs(
    spark: SparkSession,
    root: str,
    folder: str,
    jobs: DataFrame | None = None,
    rules: list[Column] | None = None,
    measured: bool = False,
) -> DataFrame:
    """Write the reports as JSON documents and return them."""
    reports = build_reports(spark, root, jobs, rules, measured)
    sinks.write_reports(reports, folder)
    return reports
