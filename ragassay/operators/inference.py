"""Worklists, answers and the rows an inference run leaves behind."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.functions.prompts import answer_prompt
from ragassay.operators.golden import fetch_batch
from ragassay.schemas import NO_ANSWER


def worklist(
    mode: str,
    golden: DataFrame | None = None,
    batch_name: str | None = None,
    questions: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(item, question, golden_record_id) rows of a run; ``item`` tells rows apart.

    ``case1`` asks the active records of a batch, ``case2`` asks free questions
    (columns ``ordinal``, ``question``) without ground truth. A limit keeps the
    first rows in id or list order.
    """
    if mode == "case1":
        if not batch_name or golden is None:
            raise ValueError("batch_name is required for case1")
        return fetch_batch(golden, batch_name, limit).select(
            F.col("id").cast("string").alias("item"),
            "question",
            F.col("id").alias("golden_record_id"),
        )
    if mode == "case2":
        if questions is None or questions.isEmpty():
            raise ValueError("source questions are required for case2")
        asked = questions.orderBy("ordinal").limit(limit) if limit else questions
        return asked.select(
            F.col("ordinal").cast("string").alias("item"),
            "question",
            F.lit(None).cast("string").alias("golden_record_id"),
        )
    raise ValueError(f"unknown mode {mode!r}: use 'case1' or 'case2'")


def with_contexts(asked: DataFrame, contexts: DataFrame, key: str = "query_id") -> DataFrame:
    """Every question keeps its row; one without hits gets an empty list."""
    kind = contexts.schema["retrieved_contexts"].dataType
    joined = asked.join(contexts.select(key, "retrieved_contexts"), key, "left")
    return joined.withColumn(
        "retrieved_contexts", F.coalesce("retrieved_contexts", F.array().cast(kind))
    )


def extractive_answer(contexts: Column) -> Column:
    """Default answer stage: the best context speaks for itself."""
    return F.get(contexts, F.lit(0))["text"]


def model_answer(generate: Callable[[str], str]) -> Callable[[Column, Column], Column]:
    """Answer stage around any prompt -> text function; an error fails the run."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else generate(p))

    def apply(contexts: Column, question: Column) -> Column:
        # no context, no prompt: the model is not asked
        return run(F.when(F.size(contexts) > 0, answer_prompt(contexts, question)))

    return apply


def answered(asked: DataFrame, answer: Column | None = None) -> DataFrame:
    """Generated answers, or the fixed apology when nothing was retrieved."""
    contexts = F.col("retrieved_contexts")
    text = extractive_answer(contexts) if answer is None else answer
    return asked.withColumn("generated_answer", F.when(F.size(contexts) == 0, NO_ANSWER).otherwise(text))


def inference_tables(run: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Rows for the four tables of a run; nothing at all when there are no results.

    ``run`` is one row of run metadata; ``results`` carries ``run_id``,
    ``query_id`` and optionally ``golden_record_id``.
    """
    runs_with_results = results.select("run_id").distinct()
    return {
        "inference_run_history": run.join(runs_with_results, "run_id", "left_semi"),
        "query_history": results.drop("run_id", "golden_record_id"),
        "inference_run_query_mapping": results.select("run_id", "query_id"),
        "golden_record_query_mapping": results.filter("golden_record_id IS NOT NULL").select(
            "query_id", "golden_record_id"
        ),
    }


def run_summary(results: DataFrame) -> DataFrame:
    """Rows written per table and run."""
    return results.groupBy("run_id").agg(
        F.lit(1).cast("bigint").alias("inference_run_history"),
        F.count("*").alias("query_history"),
        F.count("*").alias("inference_run_query_mapping"),
        F.count("golden_record_id").alias("golden_record_query_mapping"),
    )


def query_timing(history: DataFrame) -> DataFrame:
    """Latency in seconds; retrieval time is recorded as the query time."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("query_time"), F.col("response_time")) / 1e6
    return history.withColumns(
        {"retrieval_time": F.col("query_time"), "latency_seconds": seconds}
    )
