"""Synthesise a benchmark batch from seed chunks and publish it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.operators import golden
from ragassay.session import durable, ship_package
from ragassay.sources import store


def build_benchmark(
    spark: SparkSession,
    root: str,
    batch_name: str,
    sample_size: int,
    *,
    topics: list[str] | None = None,
    generate: golden.QA | None = None,
    seed: int | None = None,
    by: str = "system:dataset_runner",
) -> DataFrame:
    """Returns sampled and valid counts with the yield in percent.

    Without a valid pair the old batch stays as it is.
    """
    ship_package(spark)
    base = store.current_version(spark, root)
    chunks = store.read(spark, root, "document_chunks", base).select(
        F.col("id").alias("chunk_id"), "doc_id", "content", "is_deleted"
    )
    seeds = golden.seed_candidates(chunks)
    if topics:
        seeds = golden.with_topic_matches(
            seeds,
            store.read(spark, root, "document_topics", base),
            store.read(spark, root, "topics", base),
            topics,
        )
    key = ("chunk_id", "topic_name") if topics else ("chunk_id",)
    sampled = golden.sample(seeds, sample_size, seed, by=key if seed is not None else ())
    make = golden.generated_qa(generate) if generate else golden.lexical_qa
    # sampled and generated once: both the rows and the yield come from this result
    pairs = durable(
        sampled.select(*key, make(F.col("content")).alias("qa")).select(*key, "qa.*")
    ).withColumn("batch_name", F.lit(batch_name))

    records = golden.golden_rows(golden.accepted(pairs), batch_name, list(key), base + 1)
    if not records.isEmpty():
        old = store.read(spark, root, "golden_records", base)
        new = golden.replace_batch(old, store.conform(records, "golden_records", by), by)
        part = store.write_part(new, root, "golden_records", by)
        store.publish(spark, root, base, replace={"golden_records": [part]})
    return golden.synthesis_yield(pairs, "batch_name")
