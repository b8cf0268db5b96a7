"""Exact semantic search for whole batches of questions.

The chunk table is scanned where it lies: a bounded block of question vectors
goes to the tasks, and a task returns at most k rows per question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ragassay.functions.vectors import QueryBlock, matrix_of, normalised, similarity_hits
from ragassay.schemas import SIMILARITY_THRESHOLD, TOP_K
from ragassay.session import durable

# memory of the question vectors one scan may carry; more questions take more scans
BLOCK_BYTES = 256 * 1024 * 1024
# result rows (under 100 bytes each) that may be broadcast when texts are looked up
LOOKUP_ROWS = 200_000
# active document ids (at ~50 bytes) that may be broadcast to filter the chunk scan
LIVE_ROWS = 2_000_000
# topic names that are worth a pushed-down IN list
TOPIC_LIST = 1_000


def active(df: DataFrame) -> DataFrame:
    """Rows with ``is_deleted = false``; a null flag is not active."""
    return df.filter("is_deleted = false")


def searchable_chunks(
    chunks: DataFrame,
    documents: DataFrame,
    topics_of: DataFrame | None = None,
    all_filtered: bool = False,
) -> DataFrame:
    """Active chunks of active documents that have a vector, with the topics of
    the document when asked for.

    Everything known about documents is joined first, so the vectors meet one
    join. A counted, small document list is broadcast and the vectors stay where
    they are; a larger one goes through a shuffled join.
    """
    live = active(documents).select("doc_id")
    if topics_of is not None:
        live = live.join(topics_of, "doc_id", "inner" if all_filtered else "left")
    if live.count() <= LIVE_ROWS:
        live = F.broadcast(live)
    vectors = (
        active(chunks).filter("embedding IS NOT NULL").select("chunk_id", "doc_id", "embedding")
    )
    return vectors.join(live, "doc_id")


def topics_by_document(
    document_topics: DataFrame, topics: DataFrame, names: list[str], key: str
) -> DataFrame:
    """Wanted active topic names per document, one entry per mapping row."""
    mapped = active(document_topics).select("doc_id", key)
    named = active(topics).select(*{key, "topic_name"})
    if len(names) <= TOPIC_LIST:
        named = named.filter(F.col("topic_name").isin(names))
    else:
        wanted = topics.sparkSession.createDataFrame([(n,) for n in names], "topic_name string")
        named = named.join(wanted, "topic_name", "left_semi")
    joined = mapped.join(named, key)
    return joined.groupBy("doc_id").agg(F.collect_list("topic_name").alias("topics"))


def with_search_defaults(
    queries: DataFrame, top_k: int = TOP_K, threshold: float = SIMILARITY_THRESHOLD
) -> DataFrame:
    """Per-question overrides ``top_k``, ``similarity_threshold`` and
    ``topic_filters``; a missing or null override takes the setting."""
    have = set(queries.columns)
    k = F.col("top_k") if "top_k" in have else F.lit(None)
    t = F.col("similarity_threshold") if "similarity_threshold" in have else F.lit(None)
    topics = F.col("topic_filters") if "topic_filters" in have else F.lit(None)
    return queries.select(
        "query_id",
        "embedding",
        F.coalesce(k.cast("int"), F.lit(top_k)).alias("top_k"),
        F.coalesce(t.cast("double"), F.lit(float(threshold))).alias("similarity_threshold"),
        topics.cast("array<string>").alias("topic_filters"),
    )


def _block(rows: pa.Table, ranked: bool) -> QueryBlock:
    unit = normalised(matrix_of(rows["embedding"]))
    usable = ~np.isnan(unit).any(axis=1)
    rows = rows.filter(pa.array(usable))
    return QueryBlock(
        ids=rows["query_id"].combine_chunks(),
        unit=unit[usable],
        threshold=rows["similarity_threshold"].to_numpy(),
        top_k=rows["top_k"].to_numpy() if ranked else None,
        topics=[names or None for names in rows["topic_filters"].to_pylist()],
    )


def query_parts(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Questions in parts whose size is checked before anything is fetched."""
    known = queries.filter("embedding IS NOT NULL")
    size = known.agg(
        F.count("*").alias("n"),
        F.max(F.size("embedding")).alias("d"),
        F.max(F.greatest(F.size("topic_filters"), F.lit(0))).alias("t"),
    ).first()
    if not size.n:
        return []
    if not known.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("query_id must be unique")
    row_limit = max(1, block_bytes // (8 * size.d + 128 * (size.t or 0) + 256))
    if size.n <= row_limit:
        return [known]
    # split by key hash until the largest part fits
    parts = -(-size.n // row_limit)
    while parts <= 64 * size.n:
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        counts = known.groupBy(part.alias("p")).count()
        if counts.agg(F.max("count")).first()[0] <= row_limit:
            return [known.filter(part == p) for p in range(parts)]
        parts *= 2
    raise ValueError("one question exceeds a whole query block")


def _for_each_block(
    queries: DataFrame,
    block_bytes: int,
    ranked: bool,
    search: Callable[[QueryBlock], tuple[DataFrame, Broadcast]],
) -> list[DataFrame]:
    """Search results per block of questions.

    A single block stays a lazy plan. Several are run one after the other, each
    result written to the shared folder and its block released, so that driver
    and executors hold one block of questions at a time.
    """
    parts = query_parts(queries, block_bytes)
    results = []
    for part in parts:
        block = _block(part.toArrow(), ranked)
        if not len(block.ids):
            continue
        found, shipped = search(block)
        if len(parts) > 1:
            found = durable(found)
            shipped.destroy()
        results.append(found)
    return results


def _scan(
    chunks: DataFrame, block: QueryBlock, distinct_topics: bool = False
) -> tuple[DataFrame, Broadcast]:
    spark = chunks.sparkSession
    id_type = T.LongType() if pa.types.is_integer(block.ids.type) else T.StringType()
    out = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("doc_id", chunks.schema["doc_id"].dataType),
            T.StructField("similarity_score", T.DoubleType()),
            T.StructField("order_score", T.DoubleType()),
            T.StructField("copies", T.LongType()),
            T.StructField("top_k", T.LongType()),
        ]
    )
    arrow_out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])
    shipped = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = similarity_hits(
            shipped.value, out_schema=arrow_out, distinct_topics=distinct_topics
        )
        return kernel(batches)

    return chunks.mapInArrow(run, out), shipped


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    if not parts:
        return empty
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _no_hits(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        F.lit(None).cast("string").alias("query_id"),
        "chunk_id",
        "doc_id",
        F.lit(0.0).alias("similarity_score"),
        F.lit(0.0).alias("order_score"),
        F.lit(1).cast("long").alias("copies"),
        F.lit(1).cast("long").alias("top_k"),
    ).filter(F.lit(False))


def similar_pairs(
    queries: DataFrame,
    chunks: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every (question, chunk) pair whose cosine similarity reaches the threshold."""
    asked = with_search_defaults(queries, threshold=threshold)
    parts = _for_each_block(asked, block_bytes, False, lambda block: _scan(chunks, block))
    return _union(parts, _no_hits(chunks)).drop("order_score", "copies", "top_k")


def semantic_search(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    document_topics: DataFrame | None = None,
    topics: DataFrame | None = None,
    *,
    topic_key: str = "topic_id",
    distinct_topics: bool = False,
    top_k: int = TOP_K,
    threshold: float = SIMILARITY_THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Top-k chunks per question: (query_id, rank_no, chunk_id, doc_id, similarity_score).

    A topic filter counts a chunk once per matching topic, and each copy uses
    one of the k places; ``distinct_topics`` counts it once.
    """
    asked = with_search_defaults(queries, top_k, threshold)
    most = 0

    def search(block: QueryBlock) -> tuple[DataFrame, Broadcast]:
        nonlocal most
        most += int(block.top_k.sum())
        by_doc = None
        if block.any_filtered:
            if document_topics is None or topics is None:
                raise ValueError("topic filters need the document_topics and topics tables")
            by_doc = topics_by_document(document_topics, topics, block.wanted_topics, topic_key)
        pool = searchable_chunks(chunks, documents, by_doc, block.all_filtered)
        hits, shipped = _scan(pool, block, distinct_topics)
        return _ranked(hits), shipped

    results = _for_each_block(asked, block_bytes, True, search)
    ranked = _union(results, _ranked(_no_hits(chunks)))
    # the result has at most the sum of all k: small enough to look up texts by broadcast?
    return ranked.hint("broadcast") if most <= LOOKUP_ROWS else ranked


def _ranked(hits: DataFrame) -> DataFrame:
    """Merge the per-task winners; a group has at most k rows per scan task."""
    best = Window.partitionBy("query_id").orderBy(F.desc("order_score"), "chunk_id")
    # more copies than places can never be used
    places = F.least("copies", "top_k")
    rows = hits.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), places)))
    ranked = rows.withColumn("rank_no", F.row_number().over(best))
    return ranked.filter("rank_no <= top_k").select(
        "query_id", "rank_no", "chunk_id", "doc_id", "similarity_score"
    )


def with_chunk_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Look up text and metadata of search hits in a scan without the vectors."""
    wanted = [c for c in chunks.columns if c not in ("embedding", "is_deleted", "doc_id")]
    return chunks.select(*wanted).join(hits, "chunk_id")


def contexts_per_query(hits: DataFrame, context: Column) -> DataFrame:
    """One row per question with its contexts in rank order (k of them at most)."""
    gathered = F.array_sort(F.collect_list(F.struct("rank_no", context.alias("context"))))
    return hits.groupBy("query_id").agg(
        F.transform(gathered, lambda c: c["context"]).alias("retrieved_contexts")
    )
