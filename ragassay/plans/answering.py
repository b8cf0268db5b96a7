"""Run inference over a benchmark batch or a list of questions."""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.functions.embedding import Embedder, embed_texts
from ragassay.functions.text import stable_id
from ragassay.operators import hybrid, inference, retrieve, sparse, vector_index
from ragassay.schemas import SIMILARITY_THRESHOLD, TOP_K
from ragassay.session import durable, ship_package
from ragassay.sources import store


def _now() -> Column:
    moment = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _clock() -> Column:
    """The time at which a row passes, in UTC; another one for each row."""
    millis = F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("decimal(18,3)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=millis / 1000)


#: ways to search: all vectors, words, both, near vectors only
INDEXING = ("exact_scan", "bm25", "hybrid", "ivf")
#: length of the lists that are fused, as a multiple of the wanted chunks
FUSED = 4


def _index(spark: SparkSession, folder: str, module, live: DataFrame):
    """The index in a folder; it is built for the first search of a version."""
    try:
        return module.open_index(spark, folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return module.build_index(live, folder)


def indexed_hits(
    spark: SparkSession,
    root: str,
    version: int,
    asked: DataFrame,
    chunks: DataFrame,
    indexing: str,
    top_k: int,
    threshold: float,
) -> DataFrame:
    """Hits (query_id, rank_no, chunk_id, doc_id, similarity_score) through the indexes of a
    version, which are kept below root. The score is that of the search that ranked."""
    if {"top_k", "similarity_threshold", "topic_filters"} & set(asked.columns):
        raise ValueError("overrides per question need the exact search")
    documents = retrieve.active(store.read(spark, root, "documents", version)).select("doc_id")
    live = retrieve.active(chunks).join(documents, "doc_id", "left_semi")

    def dense(k: int) -> DataFrame:
        folder = f"{root}/indexes/ivf/v{version}"
        index = _index(spark, folder, vector_index, live.select("chunk_id", "doc_id", "embedding"))
        return vector_index.approximate_search(index, asked, k, threshold)

    if indexing == "ivf":
        return dense(top_k)
    folder = f"{root}/indexes/bm25/v{version}"
    index = _index(spark, folder, sparse, live.select("chunk_id", "content"))
    if indexing == "bm25":
        found = sparse.sparse_search(index, asked, top_k).withColumnRenamed("score", "similarity_score")
    else:
        by_words = sparse.sparse_search(index, asked, FUSED * top_k)
        found = hybrid.fused(by_words, dense(FUSED * top_k), top_k)
        found = found.withColumnRenamed("fused_score", "similarity_score")
    found = durable(found.select("query_id", "rank_no", "chunk_id", "similarity_score"))
    return live.select("chunk_id", "doc_id").join(found, "chunk_id")


def answer_questions(
    spark: SparkSession,
    root: str,
    asked: DataFrame,
    version: int,
    *,
    embed: Embedder | None = None,
    answer=None,
    top_k: int = TOP_K,
    threshold: float = SIMILARITY_THRESHOLD,
    indexing: str = INDEXING[0],
) -> DataFrame:
    """Contexts and answers for questions (query_id, question, optional overrides).

    ``indexing`` chooses the search; the threshold holds for vectors.

    ``query_time`` is the moment a question was embedded, ``response_time`` the moment
    its answer was made.
    """
    asked = asked.withColumn("query_time", _clock())
    embedded = durable(asked.withColumn("embedding", embed_texts(embed, task="query")("question")))
    chunks = store.read(spark, root, "document_chunks", version, own_flag=True).withColumnRenamed(
        "id", "chunk_id"
    )
    if indexing not in INDEXING:
        raise ValueError(f"indexing is one of {', '.join(INDEXING)}")
    if indexing != "exact_scan":
        hits = indexed_hits(spark, root, version, embedded, chunks, indexing, top_k, threshold)
    else:
        hits = retrieve.semantic_search(
            embedded,
            chunks,
            store.read(spark, root, "documents", version),
            store.read(spark, root, "document_topics", version),
            store.read(spark, root, "topics", version),
            top_k=top_k,
            threshold=threshold,
        )
    texts = chunks.select("chunk_id", "content", "metadata")
    context = F.struct(
        "doc_id", "chunk_id", F.col("content").alias("text"), "similarity_score", "metadata"
    )
    found = retrieve.contexts_per_query(retrieve.with_chunk_text(hits, texts), context)
    with_found = inference.with_contexts(embedded.drop("embedding"), found)
    text = answer(F.col("retrieved_contexts"), F.col("question")) if answer else None
    done = inference.answered(with_found, text)
    return done.withColumns({"retrieval_time": F.col("query_time"), "response_time": _clock()})


def run_inference(
    spark: SparkSession,
    root: str,
    mode: str,
    *,
    batch_name: str | None = None,
    questions: DataFrame | None = None,
    limit: int | None = None,
    run_id: str | None = None,
    config: dict[str, str] | None = None,
    by: str = "inference_runner",
    **options,
) -> DataFrame:
    """Answer a worklist and publish the run; returns the rows written per table.

    An empty batch publishes nothing.
    """
    ship_package(spark)
    base = store.current_version(spark, root)
    run_id = run_id or str(uuid.uuid4())
    golden = store.read(spark, root, "golden_records", base) if mode == "case1" else None
    items = inference.worklist(mode, golden, batch_name, questions, limit)
    asked = items.withColumn("query_id", stable_id(F.lit(run_id), F.col("item"))).drop("item")

    started = _now()
    # generated once; the four tables below all read this result
    results = durable(answer_questions(spark, root, asked, base, **options))
    results = results.withColumns(
        {
            "run_id": F.lit(run_id),
            "queried_by": F.lit(by),
        }
    )
    settings = {
        "chunking_config": "default",
        "indexing_config": options.get("indexing", INDEXING[0]),
        "reranking_config": "none",
        "prompting_config": "standard_rag",
        "generation_config": "extractive",
        **(config or {}),
    }
    run = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        started.alias("start_time"),
        _now().alias("end_time"),
        *[F.lit(value).alias(name) for name, value in settings.items()],
        F.lit(0.0).alias("cost_estimate"),
    )
    if not results.isEmpty():
        tables = inference.inference_tables(run, results)
        parts = {name: [store.write_part(rows, root, name, by)] for name, rows in tables.items()}
        store.publish(spark, root, base, append=parts)
    return inference.run_summary(results)
