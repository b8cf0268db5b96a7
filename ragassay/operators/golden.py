"""Benchmark sets: seed sampling, question synthesis, versioned batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.functions.text import stable_id
from ragassay.operators.retrieve import active
from ragassay.schemas import INVALID_CHUNK, REJECTED, SEED_MIN_LENGTH


def seed_candidates(chunks: DataFrame) -> DataFrame:
    """Active chunks long enough to ask about; their document may be deleted."""
    return active(chunks).filter(F.length("content") > SEED_MIN_LENGTH)


def with_topic_matches(
    chunks: DataFrame,
    document_topics: DataFrame,
    topics: DataFrame,
    names: list[str],
    key: str = "topic_id",
) -> DataFrame:
    """One row per chunk and matching topic, so a chunk can appear several times."""
    named = active(topics).filter(F.col("topic_name").isin(names)).select(*{key, "topic_name"})
    mapped = active(document_topics).select("doc_id", key).join(named, key)
    return chunks.join(mapped.select("doc_id", "topic_name"), "doc_id")


def sample(rows: DataFrame, size: int, seed: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Random rows through a bounded top-n, never a full sort.

    With ``by`` the order is a hash of those columns and the seed, so the same
    sample comes back on every run.
    """
    if by:
        order: list[Column] = [sampling_order(seed or 0, *by), *map(F.col, by)]
    else:
        order = [F.rand(seed)]
    return rows.orderBy(*order).limit(size)


def sampling_order(seed: int, *by: str) -> Column:
    parts = [F.col(c).cast("string") for c in by]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


# --- question synthesis --------------------------------------------------------

QA_DDL = "struct<question:string,answer:string,complexity:string>"
QA = Callable[[str], tuple[str, str, str]]


def lexical_qa(content: Column, min_words: int = 5) -> Column:
    """Default generator: the first sentence answers a templated question."""
    words = F.size(F.filter(F.split(content, r"[ \n]+"), lambda w: w != ""))
    sentence = F.trim(F.regexp_extract(content, r"^[^.!?]*[.!?]?", 0))
    subject = F.element_at(F.split(sentence, r"[ \n]+"), 1)
    usable = (words >= min_words) & (sentence != "")
    return F.struct(
        F.when(usable, F.concat(F.lit("What does the text say about "), subject, F.lit("?")))
        .otherwise(INVALID_CHUNK)
        .alias("question"),
        F.when(usable, sentence).otherwise(REJECTED).alias("answer"),
        F.when(words > 100, "Reasoning").otherwise("Factoid").alias("complexity"),
    )


def generated_qa(generate: QA) -> Callable[[Column], Column]:
    """Stage around any text -> (question, answer, complexity) function.

    A failing call loses its own chunk and nothing else.
    """

    @F.pandas_udf(QA_DDL)
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(text: str):
            try:
                return generate(text)
            except Exception:
                return INVALID_CHUNK, REJECTED, None

        rows = [one(t) for t in texts]
        return pd.DataFrame(rows, columns=["question", "answer", "complexity"])

    return run


def accepted(pairs: DataFrame) -> DataFrame:
    """Drop pairs the generator refused."""
    refused = F.col("question").contains(INVALID_CHUNK) | (F.col("answer") == REJECTED)
    return pairs.filter(~refused)


def golden_rows(
    pairs: DataFrame, batch_name: Column | str, key: list[str], version: int = 0
) -> DataFrame:
    """Accepted pairs as golden records; topics start empty.

    ``version`` of the store goes into the ids: a batch built again has new records,
    and the links of logged queries stay with the retired ones.
    """
    batch = F.lit(batch_name) if isinstance(batch_name, str) else batch_name
    return pairs.select(
        stable_id(F.lit(version), batch, *[F.col(c) for c in key], F.col("question")).alias("id"),
        batch.alias("batch_name"),
        "question",
        F.col("answer").alias("ground_truth"),
        F.array().cast("array<string>").alias("expected_topics"),
        "complexity",
    )


def synthesis_yield(pairs: DataFrame, by: str) -> DataFrame:
    """Accepted share of the sampled chunks, in percent."""
    refused = F.col("question").contains(INVALID_CHUNK) | (F.col("answer") == REJECTED)
    counted = pairs.groupBy(by).agg(
        F.count("*").alias("sampled"), F.count_if(~refused).alias("valid")
    )
    return counted.withColumn("yield_rate", F.col("valid") / F.col("sampled") * 100)


def replace_batch(golden: DataFrame, incoming: DataFrame, by: str | None = None) -> DataFrame:
    """Retire the active rows of every incoming batch name and add the new rows.

    No incoming rows means no names, so the old batch stays. With ``by`` the retired
    rows are stamped with it and the time.
    """
    names = incoming.select("batch_name").distinct().withColumn("_hit", F.lit(True))
    retire = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("is_deleted") == F.lit(False))
    joined = golden.join(names, "batch_name", "left").withColumn("_retire", retire)
    changes = {"is_deleted": F.lit(True)}
    if by is not None:
        changes |= {"updated_by": F.lit(by), "updated_at": F.localtimestamp()}
    kept = joined.withColumns(
        {c: F.when(F.col("_retire"), v).otherwise(F.col(c)) for c, v in changes.items()}
    ).select(*golden.columns)
    return kept.unionByName(incoming.withColumn("is_deleted", F.lit(False)).select(*golden.columns))


def fetch_batch(golden: DataFrame, batch_name: str, limit: int | None = None) -> DataFrame:
    """Active records of one batch; missing topics read as an empty list."""
    rows = active(golden).filter(F.col("batch_name") == batch_name)
    rows = rows.withColumn(
        "expected_topics", F.coalesce("expected_topics", F.array().cast("array<string>"))
    )
    return rows.orderBy("id").limit(limit) if limit else rows
