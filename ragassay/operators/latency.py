"""Measured latency and cost: quantile sketches per run, merged over jobs.

A run's latencies are one KLL sketch, a column of a few kilobytes that is merged with
others without reading the queries again. With SKETCH_K = 400 the rank of a quantile is
within 0.9 per cent of the asked one (99 per cent confidence, the sketch's own bound for
one quantile); sets of up to SKETCH_K values are kept whole and their quantiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 400
RANK_ERROR = 0.009
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
#: price of a million characters of questions and contexts, and of answers
READ_PRICE, WRITE_PRICE = 0.075, 0.3


def seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, also between times without a zone."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def query_costs(history: DataFrame) -> Column:
    """Cost of a logged query by the characters that were read and written."""
    contexts = F.lit(0)
    if "retrieved_contexts" in history.columns:
        lengths = F.transform("retrieved_contexts", lambda c: F.char_length(F.coalesce(c["text"], F.lit(""))))
        contexts = F.coalesce(F.aggregate(lengths, F.lit(0), lambda total, n: total + n), F.lit(0))
    read = F.char_length(F.coalesce("question", F.lit(""))) + contexts
    written = F.char_length(F.coalesce("generated_answer", F.lit("")))
    return (read * F.lit(READ_PRICE) + written * F.lit(WRITE_PRICE)) / F.lit(1_000_000.0)


def run_sketches(runs: DataFrame, history: DataFrame) -> DataFrame:
    """run_id, n, sketch, cost of the queries of each run (run_id, query_id).

    Queries without both times count for the cost only.
    """
    timed = history.select(
        "query_id", seconds(F.col("query_time"), F.col("response_time")).alias("latency"), query_costs(history).alias("cost")
    )
    return runs.select("run_id", "query_id").join(timed, "query_id").groupBy("run_id").agg(
        F.count("latency").alias("n"),
        F.kll_sketch_agg_double(F.col("latency"), SKETCH_K).alias("sketch"),
        F.sum("cost").alias("cost"),
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of several runs as one for each key, all together without a key."""
    found = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.kll_merge_agg_double(F.col("sketch"), SKETCH_K).alias("sketch"),
        F.sum("cost").alias("cost"),
    )
    return found.filter(F.col("n").isNotNull())


def profile(sketches: DataFrame) -> DataFrame:
    """Replace each sketch by its quantiles: the smallest value with at least that share of
    all values at or below it, within RANK_ERROR."""
    known = F.col("n") > 0
    quantiles = {
        name: F.when(known, F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(share)))
        for name, share in QUANTILES.items()
    }
    return sketches.withColumns(quantiles).drop("sketch")


def job_latencies(jobs: DataFrame, sketches: DataFrame) -> DataFrame:
    """job_id, latency_seconds (median), cost_estimate (of a query) for jobs (job_id,
    inference_run_id); jobs of runs without queries have none."""
    known = jobs.select("job_id", F.col("inference_run_id").alias("run_id")).join(sketches, "run_id")
    return profile(merged(known, "job_id")).select(
        "job_id", F.col("p50").alias("latency_seconds"), (F.col("cost") / F.col("n")).alias("cost_estimate")
    )
