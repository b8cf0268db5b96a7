"""Every operator as a query over the parquet test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.functions import prompts
from ragassay.functions.arrays import exploded
from ragassay.functions.embedding import embed_texts, hashing_embedder
from ragassay.functions.text import name_uuid, preview
from ragassay.operators import (
    chunkers,
    compare,
    diagnose,
    evaluate,
    export,
    golden,
    hybrid,
    inference,
    ingest,
    latency,
    metrics,
    ranking,
    rerank,
    retrieve,
    rewriting,
    sparse,
    vector_index,
)
from ragassay.schemas import METRICS
from ragassay.session import durable
from ragassay.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# settings of the checked searches: random 64-d vectors are rarely close
THRESHOLD = 0.15
SEARCH_TOPICS = ["en", "src0", "src1", "src2", "src3", "src4"]
SEED = 42
SAMPLE_SIZE = 50
HASH_DIMENSION = 64


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _big(*names: str) -> list[Column]:
    """Integer columns at one width, for comparison."""
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _rounded(*names: str, places: int = 9) -> list[Column]:
    return [F.round(F.col(n).cast("double"), places).alias(n) for n in names]


# --- sources and text preparation ------------------------------------------------


@query
def doc_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.documents(spark, sf)
    number = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/corpus/"), F.concat_ws("/", "source", "lang", number), F.lit(".txt"))
    rows = docs.select("doc_id", path.alias("path"), "text", F.split("text", "\n").alias("pages"))
    return ingest.fingerprint(rows, content="text").select(
        "doc_id", "document_name", "md5_hash", F.size("pages").cast("bigint").alias("total_pages")
    )


def _paged(docs: DataFrame) -> DataFrame:
    """A line of the text is a page."""
    return docs.withColumn("pages", F.split("text", "\n")).drop("text")


@query
def page_explode(spark: SparkSession, sf: str) -> DataFrame:
    docs = _paged(fx.documents(spark, sf).select("doc_id", "text"))
    return ingest.explode_pages(docs).select("doc_id", *_big("page_number"), "page_text")


@query
def active_documents(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.active(fx.documents(spark, sf)).select("doc_id", "doc_name")


@query
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.documents(spark, sf).select("doc_id", F.array("text").alias("pages"))
    return ingest.chunk_documents(docs).select(
        "doc_id", *_big("chunk_index", "page_number"), "content"
    )


@query
def chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    docs = _paged(fx.documents(spark, sf).select("doc_id", "text"))
    pieces = ingest.explode_pieces(docs, ingest.page_pieces(F.col("pages")))
    return pieces.select("doc_id", *_big("chunk_index", "page_number"), "content")


@query
def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    chunks = fx.text_chunks(spark, sf)
    rows = ingest.chunk_metadata_json(ingest.chunk_rows(chunks))
    return rows.select("doc_id", *_big("chunk_index"), "content", "chunking_strategy", "metadata")


@query
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of all documents, which get headings for the purpose."""
    found = chunkers.document_sections(fx.marked_documents(spark, sf))
    return found.select(
        "doc_id", "section_no", F.array_join("path", " > ").alias("heading_path"), F.md5("content").alias("content_md5")
    )


@query
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    found = chunkers.chunk_semantic(fx.documents(spark, sf).select("doc_id", "text"), hashing_embedder(HASH_DIMENSION))
    return found.select("doc_id", "chunk_index", "content")


@query
def embed_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Default embedder over every chunk; one row per dimension a text uses."""
    embed = embed_texts(hashing_embedder(HASH_DIMENSION))
    vectors = fx.text_chunks(spark, sf).select("chunk_id", embed("content").alias("embedding"))
    rows = exploded(vectors, "embedding", ["chunk_id"], "value", "dimension")
    return rows.filter("value <> 0").select("chunk_id", *_big("dimension"), *_rounded("value", places=6))


@query
def topic_id_uuid5(spark: SparkSession, sf: str) -> DataFrame:
    return fx.topics(spark, sf).select("topic_name", name_uuid(F.col("topic_name")).alias("topic_id"))


# --- versioned load -----------------------------------------------------------------


def _retired(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.retired_documents(fx.resident_documents(spark, sf), _arrivals(spark, sf))


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    paged = fx.arrivals(spark, sf).withColumn("pages", F.split("text", "\n"))
    return ingest.with_text(paged)


@query
def soft_delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    retired = _retired(spark, sf)
    chunks = fx.text_chunks(spark, sf).select("chunk_id", "doc_id", "is_deleted")

    def state(rows: DataFrame, name: str, *key: str) -> DataFrame:
        parts = [F.col(k).cast("string") for k in key]
        return ingest.soft_deleted(rows, retired).select(
            F.lit(name).alias("table_name"),
            F.concat_ws("/", *parts).alias("row_key"),
            "is_deleted",
            "newly_deleted",
        )

    return (
        state(fx.resident_documents(spark, sf), "documents", "doc_id")
        .unionByName(state(fx.resident_of(spark, sf, chunks), "document_chunks", "chunk_id"))
        .unionByName(
            state(
                fx.resident_of(spark, sf, fx.document_topics(spark, sf)),
                "document_topics", "doc_id", "topic_name",
            )
        )
    )


@query
def reingest_documents(spark: SparkSession, sf: str) -> DataFrame:
    old = ingest.soft_deleted(fx.resident_documents(spark, sf), _retired(spark, sf)).select(
        "doc_id",
        "doc_name",
        "is_deleted",
        F.lit("").alias("md5_hash"),
        F.lit(0).cast("bigint").alias("total_pages"),
    )
    new = ingest.new_document_versions(_arrivals(spark, sf)).select(
        "doc_id",
        "doc_name",
        "is_deleted",
        F.md5("text").alias("md5_hash"),
        F.size("pages").cast("bigint").alias("total_pages"),
    )
    return old.unionByName(new)


@query
def topics_upsert(spark: SparkSession, sf: str) -> DataFrame:
    known = fx.known_topics(spark, sf).withColumn("topic_id", name_uuid(F.col("topic_name")))
    incoming = _arrivals(spark, sf).select(F.explode("topics").alias("topic_name"))
    return ingest.topics_upsert(known, incoming)


@query
def document_topics_map(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.document_topics_map(_arrivals(spark, sf))


@query
def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    arrivals = _arrivals(spark, sf)
    versions = ingest.new_document_versions(arrivals.select("doc_id", "doc_name", "topics"))
    chunks = fx.text_chunks(spark, sf).drop("content")
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return ingest.ingest_stats(
        _retired(spark, sf), chunks, fx.document_topics(spark, sf),
        versions, fx.known_topics(spark, sf), counts,
    )


# --- retrieval ----------------------------------------------------------------------


def _hits(spark: SparkSession, sf: str, threshold: float = THRESHOLD, k: int = 5) -> DataFrame:
    return retrieve.semantic_search(
        fx.questions(spark, sf), fx.document_chunks(spark, sf), fx.documents(spark, sf),
        threshold=threshold, top_k=k,
    )


def _ranking(hits: DataFrame) -> DataFrame:
    return hits.select(
        *_big("query_id", "rank_no", "chunk_id", "doc_id"), *_rounded("similarity_score", places=6)
    )


@query
def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    chunks = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), "embedding"
    )
    pairs = retrieve.similar_pairs(fx.questions(spark, sf), chunks, THRESHOLD)
    return pairs.select(*_big("query_id", "chunk_id"), *_rounded("similarity_score", places=6))


@query
def semantic_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranking(_hits(spark, sf))


def _topic_search(spark: SparkSession, sf: str, distinct: bool) -> DataFrame:
    asked = fx.questions(spark, sf).withColumn(
        "topic_filters", F.array(*map(F.lit, SEARCH_TOPICS))
    )
    return _ranking(
        retrieve.semantic_search(
            asked, fx.document_chunks(spark, sf), fx.documents(spark, sf),
            fx.document_topics(spark, sf), fx.topics(spark, sf),
            topic_key="topic_name", distinct_topics=distinct, threshold=THRESHOLD,
        )
    )


@query
def semantic_search_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _topic_search(spark, sf, distinct=False)


@query
def semantic_search_topics_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return _topic_search(spark, sf, distinct=True)


@query
def semantic_search_params(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query_id")
    asked = fx.questions(spark, sf).select(
        "query_id",
        "embedding",
        F.when(q % 3 > 0, q % 4 + 1).alias("top_k"),
        F.when(q % 2 == 0, F.lit(0.2)).alias("similarity_threshold"),
        F.when(q % 5 < 2, F.array(F.lit("en"), F.concat(F.lit("src"), (q % 7).cast("string")))).alias(
            "topic_filters"
        ),
    )
    return _ranking(
        retrieve.semantic_search(
            asked, fx.document_chunks(spark, sf), fx.documents(spark, sf),
            fx.document_topics(spark, sf), fx.topics(spark, sf),
            topic_key="topic_name", threshold=THRESHOLD,
        )
    )


def _retrieved(spark: SparkSession, sf: str, threshold: float = 0.3) -> DataFrame:
    """Every question with its contexts; the threshold leaves some without any."""
    hits = retrieve.with_chunk_text(_hits(spark, sf, threshold), fx.document_chunks(spark, sf))
    context = F.struct(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("content").alias("text"),
        F.round("similarity_score", 6).alias("similarity_score"),
        F.struct(
            F.col("page_number").cast("int").alias("page_number"),
            F.lit(None).cast("int").alias("token_count"),
        ).alias("metadata"),
    )
    found = retrieve.contexts_per_query(hits, context)
    return inference.with_contexts(fx.questions(spark, sf).drop("embedding"), found)


@query
def retrieved_contexts(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploded(_retrieved(spark, sf), "retrieved_contexts", ["query_id"], "c", "pos")
    return rows.select(
        "query_id",
        (F.col("pos") + 1).cast("bigint").alias("rank_no"),
        F.col("c.chunk_id").alias("chunk_id"),
        F.col("c.doc_id").alias("doc_id"),
        F.col("c.text").alias("text"),
        F.col("c.similarity_score").alias("similarity_score"),
        F.col("c.metadata.page_number").cast("bigint").alias("page_number"),
    )


@query
def generator_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf).select(
        "query_id", prompts.answer_prompt(F.col("retrieved_contexts"), F.col("question")).alias("prompt")
    )


@query
def rag_answers(spark: SparkSession, sf: str) -> DataFrame:
    return inference.answered(_retrieved(spark, sf)).select(
        "query_id", "generated_answer", F.size("retrieved_contexts").cast("bigint").alias("n_contexts")
    )


@query
def context_preview(spark: SparkSession, sf: str) -> DataFrame:
    return fx.text_chunks(spark, sf).select("chunk_id", preview(F.col("content")).alias("preview"))


# --- sparse and hybrid retrieval ------------------------------------------------------


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text as a question."""
    items = fx.table(spark, sf, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """All active chunks of all documents, indexed and searched."""
    chunks = retrieve.active(fx.text_chunks(spark, sf)).select("chunk_id", "content")
    found = sparse.sparse_search(sparse.build_index(chunks), _asked(spark, sf), top_k=5)
    return found.select(*_big("query_id", "rank_no"), "chunk_id", *_rounded("score", places=6))


@query
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty chunks by words and ten by vectors become five; rank 0: not in that list."""
    live = retrieve.active(fx.documents(spark, sf)).select("doc_id")
    chunks = retrieve.active(fx.document_chunks(spark, sf, embedded=False))
    chunks = chunks.join(live.hint("shuffle_hash"), "doc_id", "left_semi")
    index = sparse.build_index(chunks.select("chunk_id", "content"))
    by_words = sparse.sparse_search(index, _asked(spark, sf), top_k=20)
    found = hybrid.fused(by_words, _hits(spark, sf, k=10), top_k=5).fillna(0, ["sparse_rank", "dense_rank"])
    return found.select(
        *_big("query_id", "rank_no", "chunk_id", "sparse_rank", "dense_rank"), *_rounded("fused_score")
    )


def _text_index(spark: SparkSession, sf: str) -> sparse.SparseIndex:
    return sparse.build_index(retrieve.active(fx.text_chunks(spark, sf)).select("chunk_id", "content"))


@query
def expanded_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text with five terms of its ten first chunks."""
    found = rewriting.expanded_search(_text_index(spark, sf), _asked(spark, sf), top_k=5)
    return found.select(*_big("query_id", "rank_no"), "chunk_id", *_rounded("score", places=8))


@query
def decomposed_search(spark: SparkSession, sf: str) -> DataFrame:
    found = rewriting.decomposed_search(_text_index(spark, sf), _asked(spark, sf), top_k=5)
    return found.select(*_big("query_id", "rank_no", "n_parts"), "chunk_id")


@query
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty chunks of each benchmark text become five."""
    chunks = retrieve.active(fx.text_chunks(spark, sf)).select("chunk_id", "content")
    asked = _asked(spark, sf)
    found = durable(sparse.sparse_search(sparse.build_index(chunks), asked, top_k=20))
    rows = rerank.with_texts(found, chunks).join(asked, "query_id")
    return rerank.reranked(rows, top_k=5, most=20).select(
        *_big("query_id", "rank_no", "first_rank"), "chunk_id", *_rounded("relevance", "value", places=6)
    )


@query
def ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate search, with the share of the exact result that it finds."""
    live = retrieve.active(fx.documents(spark, sf)).select("doc_id")
    chunks = retrieve.active(fx.document_chunks(spark, sf)).join(live, "doc_id", "left_semi")
    index = vector_index.build_index(chunks.select("chunk_id", "doc_id", "embedding"), list_size=64)
    found = vector_index.approximate_search(index, fx.questions(spark, sf), 5, THRESHOLD)
    met = vector_index.recall(found, _hits(spark, sf))
    mean = met.select(F.avg("recall").alias("n"))
    rows = found.join(met.select("query_id", F.col("recall").alias("query_recall")), "query_id")
    return fx.with_scalar(rows, mean, "recall").select(
        *_big("query_id", "rank_no", "chunk_id", "doc_id"),
        *_rounded("similarity_score", places=6), *_rounded("query_recall", "recall"),
    )


# --- benchmark sets -------------------------------------------------------------------


@query
def seed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = golden.seed_candidates(fx.text_chunks(spark, sf))
    picked = golden.sample(rows, SAMPLE_SIZE, SEED, by=("chunk_id",))
    return picked.select("chunk_id", "content", *_big("page_number"))


@query
def seed_chunks_topics(spark: SparkSession, sf: str) -> DataFrame:
    rows = golden.with_topic_matches(
        golden.seed_candidates(fx.text_chunks(spark, sf)),
        fx.document_topics(spark, sf), fx.topics(spark, sf), SEARCH_TOPICS, key="topic_name",
    )
    picked = golden.sample(rows, SAMPLE_SIZE, SEED, by=("chunk_id", "topic_name"))
    return picked.select("chunk_id", "topic_name", "content", *_big("page_number"))


@query
def qa_generate(spark: SparkSession, sf: str) -> DataFrame:
    rows = golden.seed_candidates(fx.text_chunks(spark, sf))
    return rows.select("chunk_id", golden.lexical_qa(F.col("content")).alias("qa")).select("chunk_id", "qa.*")


@query
def qa_reject_filter(spark: SparkSession, sf: str) -> DataFrame:
    return golden.accepted(fx.qa_pairs(spark, sf)).select("query_id", "question", "answer", "complexity")


@query
def golden_yield(spark: SparkSession, sf: str) -> DataFrame:
    rates = golden.synthesis_yield(fx.qa_pairs(spark, sf), "run_id")
    return rates.select(*_big("run_id", "sampled", "valid"), *_rounded("yield_rate"))


@query
def golden_replace_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted pairs of every run become a batch; batch_2 gets no new version."""
    old = fx.golden_records(spark, sf).withColumn("id", F.col("id").cast("string"))
    run = F.col("run_id")
    number = F.when(run < 2, run).otherwise(run + 1)
    name = F.concat(F.lit("batch_"), number.cast("string"))
    pairs = golden.accepted(fx.qa_pairs(spark, sf))
    new = golden.golden_rows(pairs, name, ["query_id"])
    return golden.replace_batch(old, new).select(
        "batch_name",
        "question",
        "ground_truth",
        "complexity",
        F.size(F.coalesce("expected_topics", F.array())).cast("bigint").alias("n_topics"),
        "is_deleted",
    )


@query
def golden_fetch_batch(spark: SparkSession, sf: str) -> DataFrame:
    return golden.fetch_batch(fx.golden_records(spark, sf), "batch_1").select(
        "id", "batch_name", "question", "ground_truth", "complexity",
        F.size("expected_topics").cast("bigint").alias("n_topics"),
    )


# --- inference ------------------------------------------------------------------------


@query
def inference_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """A benchmark run over one batch, a blind run, and a blind run with a limit."""
    case1 = inference.worklist("case1", golden=fx.golden_records(spark, sf), batch_name="batch_1")
    asked = fx.query_history(spark, sf).select(F.col("query_id").alias("ordinal"), "question")
    case2 = inference.worklist("case2", questions=asked)
    first = inference.worklist("case2", questions=asked, limit=SAMPLE_SIZE)

    def shown(rows: DataFrame, mode: str) -> DataFrame:
        golden_id = F.coalesce(F.col("golden_record_id").cast("string"), F.lit(""))
        return rows.select(F.lit(mode).alias("mode"), "question", golden_id.alias("golden_record_id"))

    return (
        shown(case1, "case1")
        .unionByName(shown(case2, "case2"))
        .unionByName(shown(first, "case2 limited"))
    )


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Run results: each query with its first golden record, if it has one."""
    linked = fx.golden_mapping(spark, sf).groupBy("query_id").agg(
        F.min("golden_record_id").alias("golden_record_id")
    )
    runs = fx.run_mapping(spark, sf).select("run_id", "query_id")
    return runs.join(linked, "query_id", "left")


@query
def inference_golden_mapping(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    run = results.select("run_id").distinct()
    return inference.inference_tables(run, results)["golden_record_query_mapping"]


@query
def inference_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inference.run_summary(_results(spark, sf))


@query
def query_latency(spark: SparkSession, sf: str) -> DataFrame:
    timed = inference.query_timing(fx.query_history(spark, sf))
    return timed.select(
        "query_id",
        F.date_format("query_time", "yyyy-MM-dd HH:mm:ss").alias("query_time"),
        F.date_format("retrieval_time", "yyyy-MM-dd HH:mm:ss").alias("retrieval_time"),
        F.date_format("response_time", "yyyy-MM-dd HH:mm:ss").alias("response_time"),
        "latency_seconds",
    )


@query
def latency_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of every run, and of all runs together from their merged sketches."""
    runs = retrieve.active(fx.run_mapping(spark, sf))
    sketches = durable(latency.run_sketches(runs, retrieve.active(fx.query_history(spark, sf))))
    own = latency.profile(sketches).withColumn("run_id", F.col("run_id").cast("string"))
    every = latency.profile(latency.merged(sketches)).withColumn("run_id", F.lit("all"))
    return own.unionByName(every).select("run_id", *_big("n"), "p50", "p90", "p99", *_rounded("cost", places=6))


# --- evaluation -------------------------------------------------------------------------


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Query log with the retrieved contexts nested per query."""
    context = F.struct(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("chunk_id").cast("string").alias("chunk_id"),
        "text",
        "similarity_score",
        F.struct(
            F.col("page_number").cast("int").alias("page_number"),
            F.lit(None).cast("int").alias("token_count"),
        ).alias("metadata"),
    )
    found = retrieve.contexts_per_query(fx.contexts(spark, sf), context)
    return inference.with_contexts(fx.query_history(spark, sf), found)


def _fetched(spark: SparkSession, sf: str, history: DataFrame | None = None) -> DataFrame:
    return evaluate.fetch_for_evaluation(
        fx.run_mapping(spark, sf),
        fx.query_history(spark, sf) if history is None else history,
        fx.golden_mapping(spark, sf),
        fx.golden_records(spark, sf),
    )


@query
def evaluation_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return _fetched(spark, sf, _history(spark, sf)).select(
        *_big("run_id", "query_id"),
        "question",
        "generated_answer",
        F.size("retrieved_contexts").cast("bigint").alias("n_contexts"),
        "ground_truth",
    )


@query
def evaluation_case_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.case_counts(_fetched(spark, sf))


@query
def judge_routing(spark: SparkSession, sf: str) -> DataFrame:
    return _fetched(spark, sf).select(
        *_big("run_id", "query_id"), evaluate.strategy(F.col("ground_truth")).alias("evaluation_strategy")
    )


@query
def judge_context_block(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select(
        "query_id", prompts.judge_context_block(F.col("retrieved_contexts")).alias("contexts")
    )


def _failing_judge(question: str, *rest: str) -> list[tuple[str, float, str]]:
    """A model that cannot cope with every third length of a question."""
    if len(question) % 3 == 0:
        raise ValueError("no answer from the model")
    return [("correctness", 1.0, "")]


@query
def judge_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A failing judge call costs its own query the scores, no other one."""
    fetched = _fetched(spark, sf, _history(spark, sf)).withColumnRenamed("run_id", "job_id")
    judged = evaluate.judged(fetched, _failing_judge, _failing_judge)
    return evaluate.job_summary(judged).select(
        F.col("job_id").cast("bigint").alias("run_id"),
        *_big("total_queries_evaluated", "metrics_generated", "failed"),
    )


def _scores(judged: DataFrame) -> DataFrame:
    return exploded(judged, "scores", ["run_id", "query_id"], "s").select(
        *_big("run_id", "query_id"),
        F.col("s.metric_name").alias("metric_name"),
        F.col("s.score").alias("score"),
        F.col("s.reasoning").alias("reasoning"),
    )


@query
def judge_correctness(spark: SparkSession, sf: str) -> DataFrame:
    with_truth = _fetched(spark, sf).filter("ground_truth IS NOT NULL")
    return _scores(evaluate.judge_correctness(with_truth))


@query
def judge_triad(spark: SparkSession, sf: str) -> DataFrame:
    blind = _fetched(spark, sf, _history(spark, sf)).filter("ground_truth IS NULL")
    return _scores(evaluate.judge_triad(blind))


@query
def judge_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(evaluate.judge_similarity(_fetched(spark, sf), hashing_embedder(HASH_DIMENSION)))


@query
def similarity_averages(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity judge's scores of every job, as metric rows and their averages."""
    jobs = fx.evaluation_jobs(spark, sf).select("job_id", F.col("inference_run_id").alias("run_id"))
    judged = evaluate.judge_similarity(_fetched(spark, sf), hashing_embedder(HASH_DIMENSION))
    rows = evaluate.metric_rows(judged.join(F.broadcast(jobs), "run_id"), arrival=[])
    table = rows.withColumn("is_deleted", F.lit(False))
    pivot = metrics.metrics_pivot(
        table, fx.query_history(spark, sf), fx.golden_mapping(spark, sf), fx.golden_records(spark, sf)
    )
    return metrics.metric_averages(pivot, jobs).select(*_big("job_id"), *_rounded("semantic_similarity"))


@query
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Logged contexts of every run against all active documents that fit the ground truths."""
    live = retrieve.active(fx.documents(spark, sf)).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    golden_rows = retrieve.active(fx.golden_records(spark, sf))
    truths = golden_rows.select(F.col("id").alias("truth_id"), "ground_truth")
    relevant = durable(ranking.relevance(sparse.build_index(live), truths))
    runs = retrieve.active(fx.run_mapping(spark, sf)).select("run_id", "query_id")
    links = fx.golden_mapping(spark, sf).select("query_id", F.col("golden_record_id").alias("truth_id"))
    asked = runs.join(links, "query_id").join(truths.select("truth_id"), "truth_id", "left_semi")
    ranked = fx.contexts(spark, sf).select("query_id", "rank_no", "chunk_id")
    found = ranking.run_metrics(ranking.query_metrics(ranked, relevant, asked, k=5))
    return found.select(*_big("run_id", "n_pairs", "n_judged"), *_rounded("ndcg", "recall", "mrr"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """All queries of all runs, judged once per job of the run."""
    jobs = fx.evaluation_jobs(spark, sf).select("job_id", F.col("inference_run_id").alias("run_id"))
    judged = evaluate.default_judges(_fetched(spark, sf, _history(spark, sf)))
    # eight jobs at most; the texts have done their part
    return judged.select("run_id", "query_id", "ground_truth", "scores").join(F.broadcast(jobs), "run_id")


@query
def eav_flatten(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.metric_rows(_judged(spark, sf), arrival=[])
    return rows.select(
        *_big("job_id", "query_id"),
        "evaluation_strategy",
        "metric_category",
        "metric_name",
        F.col("metric_value").cast("double").alias("metric_value"),
        "reasoning",
    )


@query
def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.job_summary(_judged(spark, sf)).select(
        *_big("job_id", "total_queries_evaluated", "metrics_generated")
    )


@query
def evaluation_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One new job per run that has queries to evaluate."""
    fetched = _fetched(spark, sf)
    runs = fetched.select("run_id").distinct().select(
        F.concat(F.lit("job-"), F.col("run_id").cast("string")).alias("job_id"),
        "run_id",
        F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("start_time"),
    )
    return evaluate.job_rows(runs, model="lexical").select(
        "job_id",
        "inference_run_id",
        F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        "evaluator_model",
        "evaluator_prompt_version",
    )


@query
def metrics_insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the second half of the month arrive on top of the first half."""
    rows = fx.metric_candidates(spark, sf)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old = evaluate.first_row_per_key(rows.filter(F.col("ts") < cut), evaluate.METRIC_KEY, "event_id")
    new = evaluate.insert_if_absent(old, rows.filter(F.col("ts") >= cut), "event_id")
    return new.select(
        *_big("event_id", "job_id", "query_id"),
        "evaluation_strategy",
        "metric_name",
        F.col("metric_value").cast("double").alias("metric_value"),
        "reasoning",
    )


@query
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every job against job 0 on the queries both have scored, with the report's thresholds."""
    rows = retrieve.active(fx.evaluation_metrics(spark, sf)).select(
        F.col("job_id").alias("run_id"), "query_id", "metric_name", F.col("metric_value").alias("value")
    )
    least = [("context_relevance", 3.5), ("faithfulness", 4.0), ("answer_relevance", 3.5)]
    limits = spark.createDataFrame(least, "metric_name string, least double")
    found = compare.with_thresholds(compare.compare_runs(rows, 0), limits)
    return found.select(
        *_big("run_id", "n_pairs"), "metric_name", "verdict",
        *_rounded("baseline_mean", "run_mean", "difference", "low", "high", "least"),
    )


# --- metrics and diagnosis ------------------------------------------------------------------


def _pivot(
    spark: SparkSession, sf: str, history: DataFrame | None = None, jobs: DataFrame | None = None
) -> DataFrame:
    return metrics.metrics_pivot(
        fx.evaluation_metrics(spark, sf),
        fx.query_history(spark, sf) if history is None else history,
        fx.golden_mapping(spark, sf),
        fx.golden_records(spark, sf),
        jobs,
    )


def _averages(spark: SparkSession, sf: str) -> DataFrame:
    jobs = fx.requested_jobs(spark, sf)
    return metrics.metric_averages(_pivot(spark, sf, jobs=jobs), jobs)


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.job_metadata(
        fx.evaluation_jobs(spark, sf), fx.run_mapping(spark, sf), fx.golden_mapping(spark, sf),
        fx.golden_records(spark, sf), fx.requested_jobs(spark, sf),
    )


@query
def metrics_pivot(spark: SparkSession, sf: str) -> DataFrame:
    scores = [F.col(f"{m}_score").cast("double").alias(f"{m}_score") for m in METRICS]
    return _pivot(spark, sf).select(
        *_big("job_id", "query_id"),
        "question",
        "generated_answer",
        "ground_truth",
        *scores,
        *[f"{m}_reasoning" for m in METRICS],
    )


@query
def metric_averages(spark: SparkSession, sf: str) -> DataFrame:
    return _averages(spark, sf).select(*_big("job_id"), *_rounded(*METRICS))


@query
def job_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _metadata(spark, sf)


@query
def overall_quality(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.overall_quality(_averages(spark, sf)).select(*_big("job_id"), "quality_score")


@query
def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return diagnose.stage_metrics_long(_averages(spark, sf)).select(
        *_big("job_id"), "stage", "metric_name", *_rounded("value")
    )


def _findings(averages: DataFrame, rules: list[Column]) -> DataFrame:
    rows = diagnose.findings(diagnose.diagnosed(averages, rules))
    return rows.select(
        *_big("job_id", "finding_no"),
        "issue",
        F.array_join("evidence", "|").alias("evidence"),
        F.array_join("likely_root_causes", "|").alias("likely_root_causes"),
        F.array_join("recommended_actions", "|").alias("recommended_actions"),
    )


@query
def rule_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(_averages(spark, sf), [diagnose.retrieval_rule()])


@query
def rule_hallucination(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(_averages(spark, sf), [diagnose.hallucination_rule()])


@query
def rule_answer_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(_averages(spark, sf), [diagnose.answer_relevance_rule(2.5, 3.5)])


@query
def rule_correctness(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(_averages(spark, sf), [diagnose.correctness_rule()])


@query
def diagnose_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(_averages(spark, sf), diagnose.standard_rules())


@query
def report_file_name(spark: SparkSession, sf: str) -> DataFrame:
    """File of every requested job, and of every batch name as a data set."""
    jobs = _metadata(spark, sf).select("dataset_name", F.col("job_id").cast("string").alias("job_id"))
    kind = F.when(F.length("text") > 2000, "benchmark").otherwise("case2")
    batches = fx.documents(spark, sf).select(
        F.concat_ws("_", "lang", kind, "source").alias("dataset_name"), F.md5("text").alias("job_id")
    )
    plain = fx.golden_records(spark, sf).select(
        F.col("batch_name").alias("dataset_name"), F.md5("ground_truth").alias("job_id")
    )
    rows = jobs.unionByName(batches).unionByName(plain)
    name = diagnose.report_file(F.col("dataset_name"), F.col("job_id"))
    return rows.withColumn("report_file", name)


@query
def diagnosis_report(spark: SparkSession, sf: str) -> DataFrame:
    averages = _averages(spark, sf).select("job_id", *_rounded(*METRICS))
    built = diagnose.reports(averages, _metadata(spark, sf), diagnose.standard_rules())
    return built.select(*_big("job_id"), "report_file", F.to_json("report").alias("report"))


# --- export -----------------------------------------------------------------------------------


@query
def export_job_case1(spark: SparkSession, sf: str) -> DataFrame:
    return export.case1_job(_pivot(spark, sf)).select(*_big("job_id"))


@query
def export_job_case2(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted runs: all logged runs, and one per conversation group that has no job."""
    runs = fx.query_history(spark, sf).select((F.col("conv_id") % 6).alias("run_id")).distinct()
    jobs = fx.evaluation_jobs(spark, sf)
    return export.case2_job(jobs, _pivot(spark, sf), runs).select(*_big("run_id", "job_id"))


@query
def export_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    contexts = F.transform(
        "retrieved_contexts",
        lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text")),
    )
    history = _history(spark, sf).withColumn("retrieved_contexts", contexts)
    return export.export_rows(_pivot(spark, sf, history))
