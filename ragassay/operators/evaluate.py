"""From logged queries to scored metric rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.functions.aggregates import first_row_per_key
from ragassay.functions.arrays import exploded
from ragassay.functions.embedding import Embedder, call_with_retry, hashing_embedder
from ragassay.functions.numbers import fixed_text
from ragassay.functions.prompts import judge_context_block
from ragassay.functions.text import token_set
from ragassay.operators.retrieve import active
from ragassay.schemas import CASE1, CASE2, EMBEDDING_BATCH, METRIC_CATEGORY, SCORE_DDL

METRIC_KEY = ["query_id", "evaluation_strategy", "metric_name", "job_id"]


def ground_truths(golden_mapping: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, golden_record_id, ground_truth) per mapping row.

    A deleted golden record leaves its mapping row with a null ground truth;
    the mapping itself is taken as it is, deleted or not. Resolving the links
    first keeps queries without any link out of the join on the record id, where
    their null keys would all meet in one task.
    """
    truths = active(golden).select(F.col("id").alias("golden_record_id"), "ground_truth")
    links = golden_mapping.select("query_id", "golden_record_id")
    return links.join(truths, "golden_record_id", "left")


def fetch_for_evaluation(
    run_mapping: DataFrame, history: DataFrame, golden_mapping: DataFrame, golden: DataFrame
) -> DataFrame:
    """Queries of every run with their ground truth, if there is one."""
    asked = active(run_mapping).select("run_id", "query_id").join(
        active(history).drop("is_deleted"), "query_id"
    )
    joined = asked.join(ground_truths(golden_mapping, golden), "query_id", "left")
    out = joined.withColumn("generated_answer", F.coalesce("generated_answer", F.lit("")))
    if "retrieved_contexts" in out.columns:
        kind = out.schema["retrieved_contexts"].dataType
        out = out.withColumn(
            "retrieved_contexts", F.coalesce("retrieved_contexts", F.array().cast(kind))
        )
    return out


def strategy(ground_truth: Column) -> Column:
    """An empty ground truth still counts as one; only null means there is none."""
    return F.when(ground_truth.isNotNull(), CASE1).otherwise(CASE2)


def case_counts(fetched: DataFrame) -> DataFrame:
    has = F.col("ground_truth").isNotNull()
    return fetched.groupBy("run_id").agg(
        F.count("*").alias("total_queries"),
        F.count_if(has).alias("case1_queries"),
        F.count_if(~has).alias("case2_queries"),
    )


# --- judges --------------------------------------------------------------------
# A judge fills the ``scores`` column: array of (metric_name, score, reasoning).


def contexts_text(contexts: Column) -> Column:
    return F.array_join(F.transform(contexts, lambda c: c["text"]), "\n")


def with_overlaps(fetched: DataFrame) -> DataFrame:
    """Token-set sizes and overlaps of question, answer, contexts and truth.

    Every text is tokenised once into its own column. Texts a query's judge
    does not look at stay null and are not tokenised at all.
    """
    truth, blind = F.col("ground_truth"), F.col("ground_truth").isNull()
    sets = {
        "_said": token_set(F.col("generated_answer")),
        "_truth": F.when(truth.isNotNull(), token_set(truth)),
        "_asked": F.when(blind, token_set(F.col("question"))),
    }
    if "retrieved_contexts" in fetched.columns:
        sets["_found"] = F.when(blind, token_set(contexts_text(F.col("retrieved_contexts"))))
    else:
        sets["_found"] = F.lit(None).cast("array<string>")

    def shared(left: str, right: str) -> Column:
        return F.size(F.array_intersect(left, right))

    sizes = {
        "_n_asked": F.size("_asked"),
        "_n_said": F.size("_said"),
        "_n_both": F.size("_said") + F.size("_truth"),
        "_said_truth": 2 * shared("_said", "_truth"),
        "_asked_found": shared("_asked", "_found"),
        "_said_found": shared("_said", "_found"),
        "_asked_said": shared("_asked", "_said"),
    }
    return fetched.withColumns(sets).withColumns(sizes).drop(*sets)


def _score(part: str, whole: str) -> Column:
    share = F.col(part) / F.col(whole) * 5.0
    return F.round(F.when(F.col(whole) > 0, share).otherwise(0.0), 4)


def _scored(name: str, part: str, whole: str, score: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("metric_name"),
        (_score(part, whole) if score is None else score).alias("score"),
        F.concat(
            F.lit("shared tokens: "),
            F.col(part).cast("string"),
            F.lit(" of "),
            F.col(whole).cast("string"),
        ).alias("reasoning"),
    )


def says_unanswerable(answer: Column) -> Column:
    """An answer that states the context does not hold the answer."""
    return F.lower(answer).rlike("cannot answer|not available in the provided documents")


def correctness_scores() -> Column:
    """Token-set F1 of answer and ground truth, times five."""
    return F.array(_scored("correctness", "_said_truth", "_n_both"))


def triad_scores() -> Column:
    """Token overlaps of question, contexts and answer, times five.

    An answer that abstains invents nothing: its faithfulness is 5.
    """
    abstains = says_unanswerable(F.col("generated_answer"))
    faithful = F.when(abstains, 5.0).otherwise(_score("_said_found", "_n_said"))
    return F.array(
        _scored("context_relevance", "_asked_found", "_n_asked"),
        _scored("faithfulness", "_said_found", "_n_said", faithful),
        _scored("answer_relevance", "_asked_said", "_n_asked"),
    )


def _without_overlaps(judged: DataFrame) -> DataFrame:
    return judged.drop(*[c for c in judged.columns if c.startswith("_")])


def judge_correctness(fetched: DataFrame) -> DataFrame:
    """Ground-truth judge alone; a query without ground truth is an error."""
    message = F.concat(F.lit("no ground truth for query "), F.col("query_id").cast("string"))
    checked = fetched.withColumn(
        "ground_truth",
        F.coalesce("ground_truth", F.raise_error(message).cast("string")),
    )
    return _without_overlaps(with_overlaps(checked).withColumn("scores", correctness_scores()))


def judge_triad(fetched: DataFrame) -> DataFrame:
    """Triad judge alone; it does not look at any ground truth."""
    blind = fetched.withColumn("ground_truth", F.lit(None).cast("string"))
    return _without_overlaps(with_overlaps(blind).withColumn("scores", triad_scores()))


def default_judges(fetched: DataFrame) -> DataFrame:
    """Route each query to its judge."""
    has_truth = F.col("ground_truth").isNotNull()
    scores = F.when(has_truth, correctness_scores()).otherwise(triad_scores())
    return _without_overlaps(with_overlaps(fetched).withColumn("scores", scores))


Scorer = Callable[..., list[tuple[str, float, str]]]


def judged_by(score: Scorer) -> Callable[..., Column]:
    """Judge stage around any scorer over text columns.

    A failing call gives that query no scores; the other queries go on.
    """

    @F.pandas_udf(SCORE_DDL)
    def run(*fields: pd.Series) -> pd.Series:
        def one(*values):
            try:
                return [
                    {"metric_name": n, "score": float(s), "reasoning": r}
                    for n, s, r in score(*values)
                ]
            except Exception:
                return []

        return pd.Series([one(*values) for values in zip(*fields)])

    return run


def judged(
    fetched: DataFrame, correctness: Scorer | None = None, triad: Scorer | None = None
) -> DataFrame:
    """Route each query to its judge: a given scorer, else the default of that case.

    Each scorer sees only its own rows.
    """
    if correctness is None and triad is None:
        return default_judges(fetched)
    truth = F.col("ground_truth")
    case1, case2 = fetched.filter(truth.isNotNull()), fetched.filter(truth.isNull())
    if correctness is None:
        case1 = default_judges(case1)
    else:
        scores = judged_by(correctness)("question", "ground_truth", "generated_answer")
        case1 = case1.withColumn("scores", scores)
    if triad is None:
        case2 = default_judges(case2)
    else:
        block = judge_context_block(F.col("retrieved_contexts"))
        scores = judged_by(triad)(F.col("question"), block, F.col("generated_answer"))
        case2 = case2.withColumn("scores", scores)
    return case1.unionByName(case2)


def similarities(embed: Embedder | None = None) -> Callable[[Column, Column], Column]:
    """Cosine of the vectors of two texts of a row, both embedded in one pass.

    Null where a text is null, or where the model fails for this row alone; a text without
    a direction has cosine 0.
    """
    model = embed or hashing_embedder()

    def cosines(left: list[str], right: list[str]) -> np.ndarray:
        vectors = call_with_retry(model, left + right, "similarity", attempts=1)
        one, two = vectors[: len(left)].astype(float), vectors[len(left) :].astype(float)
        norms = np.linalg.norm(one, axis=1) * np.linalg.norm(two, axis=1)
        # default vectors have length one up to single precision; others any length
        scale = np.where(np.abs(norms - 1) < 1e-6, 1.0, np.where(norms == 0, 1.0, norms))
        return np.einsum("ij,ij->i", one, two) / scale

    def alone(pair: tuple[str, str]) -> float | None:
        try:
            return float(cosines([pair[0]], [pair[1]])[0])
        except Exception:
            return None

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            pairs = list(zip(left.to_pylist(), right.to_pylist(), strict=True))
            out: list[float | None] = [None] * len(pairs)
            whole = [i for i, p in enumerate(pairs) if None not in p]
            for start in range(0, len(whole), EMBEDDING_BATCH):
                group = whole[start : start + EMBEDDING_BATCH]
                texts = [pairs[i] for i in group]
                try:
                    found = cosines([p[0] for p in texts], [p[1] for p in texts]).tolist()
                except Exception:
                    found = [alone(p) for p in texts]  # one failing text does not take the others with it
                for i, value in zip(group, found, strict=True):
                    out[i] = value
            yield pa.array(out, pa.float64())

    return run


def with_similarity(judged: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """Add the semantic similarity of answer and ground truth to the scores of a row.

    The score is five times the cosine, 0 for a negative one. Rows without a ground truth
    keep their scores.
    """
    rows = judged.withColumn("_cosine", similarities(embed)(F.col("generated_answer"), F.col("ground_truth")))
    cosine = F.col("_cosine")
    score = F.struct(
        F.lit("semantic_similarity").alias("metric_name"),
        F.round(F.greatest(cosine, F.lit(0.0)) * 5.0, 4).alias("score"),
        F.concat(F.lit("cosine of answer and ground truth: "), fixed_text(cosine, 4)).alias("reasoning"),
    )
    more = F.when(cosine.isNotNull(), F.array(score)).otherwise(F.array().cast(SCORE_DDL))
    return rows.withColumn("scores", F.concat("scores", more)).drop("_cosine")


def judge_similarity(fetched: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """Similarity judge alone, for queries with a ground truth."""
    known = fetched.filter("ground_truth IS NOT NULL")
    return with_similarity(known.withColumn("scores", F.array().cast(SCORE_DDL)), embed)


def metric_rows(judged: DataFrame, arrival: list[str]) -> DataFrame:
    """Long metric rows; ``arrival`` keeps the columns that order repeated keys."""
    rows = exploded(judged, "scores", ["job_id", "query_id", "ground_truth", *arrival], "s")
    return rows.select(
        "job_id",
        "query_id",
        strategy(F.col("ground_truth")).alias("evaluation_strategy"),
        F.lit(METRIC_CATEGORY).alias("metric_category"),
        F.col("s.metric_name").alias("metric_name"),
        F.col("s.score").cast("decimal(5,4)").alias("metric_value"),
        F.col("s.reasoning").alias("reasoning"),
        *arrival,
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Incoming rows that may be inserted: first per key, and key not stored yet.

    A null job never conflicts. Repeats are reduced before the shuffle, so one
    key may hold any share of the batch; only keys of the table are read, and of them
    only those of jobs that arrive.
    """
    keyed = incoming.filter("job_id IS NOT NULL")
    first = first_row_per_key(keyed, METRIC_KEY, order)
    jobs = keyed.select("job_id").distinct()
    stored = existing.select(*METRIC_KEY).join(jobs, "job_id", "left_semi")
    new = first.join(stored, METRIC_KEY, "left_anti")
    return new.unionByName(incoming.filter("job_id IS NULL"))


def job_rows(runs: DataFrame, model: str, prompt_version: str = "v1.0") -> DataFrame:
    """One job row per run to evaluate (columns job_id, run_id, start_time)."""
    return runs.select(
        "job_id",
        F.col("run_id").alias("inference_run_id"),
        "start_time",
        F.col("start_time").alias("end_time"),
        F.lit(model).alias("evaluator_model"),
        F.lit(prompt_version).alias("evaluator_prompt_version"),
    )


def job_summary(judged: DataFrame) -> DataFrame:
    """Queries evaluated, scores produced and queries left without any score, per job."""
    return judged.groupBy("job_id").agg(
        F.count("*").alias("total_queries_evaluated"),
        F.sum(F.size("scores")).alias("metrics_generated"),
        F.count_if(F.size("scores") == 0).alias("failed"),
    )
