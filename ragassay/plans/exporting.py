"""CSV exports of scored jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.operators import export
from ragassay.plans.diagnosis import stored_pivot
from ragassay.session import durable
from ragassay.sources import sinks, store

CASE1_FILE = "case1_benchmark_evaluation.csv"
CASE2_FILE = "case2_blind_test_evaluation.csv"


def export_evaluations(
    spark: SparkSession, root: str, folder: str, blind_run: str
) -> dict[str, DataFrame]:
    """Write both CSVs; a case without any job writes no file.

    Case 2 takes the newest job of the blind run, else the best covered job.
    """
    jobs = store.read(spark, root, "evaluation_job_history")
    # one narrow pass over the metrics chooses the jobs, then only their rows are pivoted
    pivot = durable(
        stored_pivot(spark, root).select(
            "job_id", "query_id", "correctness_score", "faithfulness_score"
        )
    )
    wanted = spark.range(1).select(F.lit(blind_run).alias("run_id"))
    chosen = {
        CASE1_FILE: export.case1_job(pivot),
        CASE2_FILE: export.case2_job(jobs, pivot, wanted).select("job_id"),
    }
    written = {}
    for name, job in chosen.items():
        if not job.isEmpty():
            rows = export.export_rows(stored_pivot(spark, root, job))
            sinks.write_evaluation_csv(rows, f"{folder}/{name}")
            written[name] = rows
    return written
