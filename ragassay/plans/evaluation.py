"""Judge the queries of inference runs and store the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.functions.embedding import Embedder
from ragassay.functions.text import stable_id
from ragassay.operators import evaluate
from ragassay.session import durable, ship_package
from ragassay.sources import store


def evaluate_runs(
    spark: SparkSession,
    root: str,
    run_ids: list[str] | None = None,
    *,
    correctness: evaluate.Scorer | None = None,
    triad: evaluate.Scorer | None = None,
    similarity: Embedder | None = None,
    model: str | None = None,
    prompt_version: str = "v1.0",
    by: str = "evaluation_pipeline",
) -> DataFrame:
    """Evaluate the given runs (all by default), one new job per run.

    With an embedder as ``similarity`` the queries that have a ground truth also get the
    semantic similarity of their answer to it. Where a judge is not given the lexical default scores instead; without a ``model``
    name the jobs record which of the two ran.
    Returns queries evaluated and scores produced per job; a run without
    queries gets no job. The job rows are published before scoring starts.
    """
    ship_package(spark)
    if model is None:
        names = ("lexical" if judge is None else "given" for judge in (correctness, triad))
        model = "correctness: {}, triad: {}".format(*names)
    base = store.current_version(spark, root)
    mapping = store.read(spark, root, "inference_run_query_mapping", base)
    if run_ids is not None:
        mapping = mapping.filter(F.col("run_id").isin(run_ids))
    fetched = evaluate.fetch_for_evaluation(
        mapping,
        store.read(spark, root, "query_history", base),
        store.read(spark, root, "golden_record_query_mapping", base),
        store.read(spark, root, "golden_records", base),
    )
    fetched = fetched.withColumn("job_id", stable_id(F.lit(f"{base + 1}"), F.col("run_id")))
    runs = fetched.select("job_id", "run_id").distinct().withColumn("start_time", F.localtimestamp())
    job_part = store.write_part(
        evaluate.job_rows(runs, model, prompt_version), root, "evaluation_job_history", by
    )
    own = spark.createDataFrame([(job_part,)], "load string")
    jobs = store.read_part(spark, root, "evaluation_job_history", own)
    if jobs.isEmpty():
        return evaluate.job_summary(fetched.withColumn("scores", F.array()))
    base = store.publish(spark, root, base, append={"evaluation_job_history": [job_part]})

    judged = evaluate.judged(fetched, correctness, triad)
    if similarity is not None:
        judged = evaluate.with_similarity(judged, similarity)
    judged = durable(judged.select("job_id", "query_id", "golden_record_id", "ground_truth", "scores"))
    rows = evaluate.metric_rows(judged, arrival=["golden_record_id"])
    new = evaluate.insert_if_absent(
        store.read(spark, root, "evaluation_metrics", base), rows, "golden_record_id"
    ).withColumn(
        "id",
        stable_id(*[F.col(c) for c in evaluate.METRIC_KEY]),
    )
    part = store.write_part(new, root, "evaluation_metrics", by)
    store.publish(spark, root, base, append={"evaluation_metrics": [part]})
    return evaluate.job_summary(judged)
