"""Evaluation tables derived from the parquet test tables.

The test data has documents, vectors, conversations and events but no
evaluation tables; these builders derive them from the whole input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.functions.aggregates import first_row_per_key
from ragassay.operators.ingest import chunk_documents

METRIC_KEY = ["query_id", "evaluation_strategy", "metric_name", "job_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _count_of(df: DataFrame, column: str) -> DataFrame:
    """One-row frame used as a scalar."""
    return df.select(F.countDistinct(column).alias("n"))


def with_scalar(df: DataFrame, scalar: DataFrame, name: str) -> DataFrame:
    """Attach a one-row aggregate as a column through a scalar subquery."""
    return df.withColumn(name, scalar.select("n").scalar())


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang").alias("doc_name"),
        "text",
        "source",
        "lang",
        (F.col("doc_id") % 7 == 0).alias("is_deleted"),
    )


def topics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    names = docs.select(F.explode(F.array("lang", "source")).alias("topic_name")).distinct()
    return names.withColumn("is_deleted", F.col("topic_name") == "src13")


def known_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic table before an ingest: the sources only."""
    docs = table(spark, sf, "documents")
    names = docs.select(F.col("source").alias("topic_name")).distinct()
    return names.withColumn("is_deleted", F.col("topic_name") == "src13")


def document_topics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        F.explode(F.array("lang", "source")).alias("topic_name"),
        (F.col("doc_id") % 11 == 0).alias("is_deleted"),
    )


def document_chunks(spark: SparkSession, sf: str, embedded: bool = True) -> DataFrame:
    """The searched chunks, one per given vector: the halves of a document's text.

    There are fewer vectors than documents; queries that need no given vector take
    ``text_chunks``. Without the embedding column a task holds the ids and lets the texts pass
    by; it sorts none.
    """
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.floor(F.col("vec_id") / 2).alias("doc_id"),
        *(["embedding"] if embedded else []),
    )
    if not embedded:
        vectors = vectors.hint("shuffle_hash")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    half = F.ceil(F.length("text") / 2).cast("int")
    index = (F.col("chunk_id") - 2 * F.col("doc_id")).cast("int")
    content = F.when(index == 0, F.substr("text", F.lit(1), half)).otherwise(
        F.substr("text", half + 1)
    )
    return vectors.join(docs, "doc_id").select(
        "chunk_id",
        "doc_id",
        index.alias("chunk_index"),
        content.alias("content"),
        (index + 1).alias("page_number"),
        *(["embedding"] if embedded else []),
        (F.col("chunk_id") % 13 == 0).alias("is_deleted"),
    )


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk the chunker makes of every document."""
    docs = documents(spark, sf).select("doc_id", F.array("text").alias("pages"))
    number = F.col("doc_id") + F.col("chunk_index")
    return chunk_documents(docs).select(
        F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"),
        "doc_id",
        "chunk_index",
        "content",
        "page_number",
        (number % 13 == 0).alias("is_deleted"),
    )


def marked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with headings of three levels in front of some of their lines."""

    def marked(line: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        return (
            F.when(i % 7 == 0, F.concat(F.lit("# Part "), number, F.lit("\n"), line))
            .when(i % 7 == 3, F.concat(F.lit("## Section "), number, F.lit(" ##\n"), line))
            .when(i % 7 == 4, F.concat(F.lit("1.2.3 Detail "), number, F.lit("\n"), line))
            .otherwise(line)
        )

    lines = F.transform(F.split("text", "\n"), marked)
    return documents(spark, sf).select("doc_id", F.array_join(lines, "\n").alias("text"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item as a question with its vector."""
    items = table(spark, sf, "benchmark")
    vectors = table(spark, sf, "embeddings")
    return items.join(vectors, items.item_id == vectors.vec_id).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), "embedding"
    )


def query_history(spark: SparkSession, sf: str) -> DataFrame:
    """User turns answered by the assistant in the turn numbered next."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated_answer")
    )
    query_id = F.col("conv_id") * 100 + F.col("turn")
    start = _ntz("2024-01-01 00:00:00")

    def after(seconds: Column) -> Column:
        return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))

    return asked.join(replies, ["conv_id", "turn"]).select(
        query_id.alias("query_id"),
        "conv_id",
        "turn",
        "question",
        "generated_answer",
        after(query_id).alias("query_time"),
        after(query_id + 1 + query_id % 7).alias("response_time"),
        ((query_id % 17 == 0) & (query_id > 0)).alias("is_deleted"),
    )


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved chunks of each logged query: up to two active documents."""
    asked = query_history(spark, sf).select("query_id", "conv_id", "turn")
    slots = F.when(F.col("turn") > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    wanted = asked.select("query_id", "conv_id", "turn", F.explode(slots).alias("rank_no"))
    wanted = wanted.withColumn(
        "doc_id",
        F.when(F.col("rank_no") == 1, F.col("conv_id")).otherwise(F.col("conv_id") + F.col("turn")),
    )
    docs = documents(spark, sf).filter("is_deleted = false").select("doc_id", "text")
    return wanted.join(docs, "doc_id").select(
        "query_id",
        "rank_no",
        "doc_id",
        F.col("doc_id").alias("chunk_id"),
        "text",
        (F.lit(1.0) / (F.col("rank_no") + 1)).alias("similarity_score"),
        F.col("rank_no").alias("page_number"),
    )


def run_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return query_history(spark, sf).select(
        (F.col("conv_id") % 4).alias("run_id"),
        "query_id",
        ((F.col("query_id") % 19 == 0) & (F.col("query_id") > 0)).alias("is_deleted"),
    )


def golden_records(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        item.alias("id"),
        F.concat(F.lit("batch_"), (item % 3).cast("string")).alias("batch_name"),
        F.concat(F.lit("Which passage is item "), item.cast("string"), F.lit("?")).alias(
            "question"
        ),
        F.col("text").alias("ground_truth"),
        F.when(item % 4 > 0, F.array(F.lit("benchmark"))).alias("expected_topics"),
        F.when(item % 2 == 0, "Factoid").otherwise("Reasoning").alias("complexity"),
        (item % 9 == 0).alias("is_deleted"),
    )


def golden_mapping(spark: SparkSession, sf: str) -> DataFrame:
    asked = query_history(spark, sf).filter("conv_id % 2 = 0").select("query_id")
    items = _count_of(table(spark, sf, "benchmark"), "item_id")
    shifts = F.when(F.col("query_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    expanded = with_scalar(asked, items, "n_items").select(
        "query_id", "n_items", F.explode(shifts).alias("shift")
    )
    return expanded.select(
        "query_id",
        ((F.col("query_id") + F.col("shift")) % F.col("n_items")).alias("golden_record_id"),
    )


def evaluation_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "events").select((F.col("user_id") % 8).alias("job_id")).distinct()
    return jobs.select(
        "job_id",
        F.when(F.col("job_id") != 7, F.col("job_id") % 4).alias("inference_run_id"),
        (
            _ntz("2024-02-01 00:00:00")
            + F.make_dt_interval(days=((F.col("job_id") * 5) % 8).cast("int"))
        ).alias("start_time"),
    )


def requested_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Job ids somebody asks for; two of them do not exist."""
    return table(spark, sf, "events").select((F.col("user_id") % 10).alias("job_id")).distinct()


def metric_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Scores as they arrive: repeated keys, partly for unknown queries."""
    convs = _count_of(table(spark, sf, "conversations"), "conv_id")
    events = with_scalar(table(spark, sf, "events"), convs, "n_convs")
    kind = F.col("event_type")
    job = F.col("user_id") % 8
    # jobs 4 to 6 compute fewer metrics: the events of the others count for another one
    metric = (
        F.when((kind == "signup") | (job == 6), "correctness")
        .when(kind == "click", "context_relevance")
        .when(kind == "view", "faithfulness")
        .when((kind == "purchase") | job.isin(4, 5), "answer_relevance")
        .otherwise("semantic_similarity")
    )
    rows = events.select(
        "event_id",
        "ts",
        job.alias("job_id"),
        (
            (F.col("event_id") % F.col("n_convs")) * 100
            + F.floor(F.col("event_id") / F.col("n_convs")) % 4
        ).alias("query_id"),
        F.when(metric == "correctness", "CASE1_GROUND_TRUTH")
        .otherwise("CASE2_RAG_TRIAD")
        .alias("evaluation_strategy"),
        F.lit("generation").alias("metric_category"),
        metric.alias("metric_name"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    job, name = F.col("job_id"), F.col("metric_name")
    offset = F.when((name == "answer_relevance") & (job % 2 == 1), 0.0).otherwise((job % 6) * 0.5)
    bonus = F.when(name == "faithfulness", 1.25).when(name == "correctness", 0.5).otherwise(0.0)
    value = F.least(F.lit(5.0), (F.col("cents") % 251).cast("double") / 100 + offset + bonus)
    return rows.select(
        "event_id",
        "ts",
        "job_id",
        "query_id",
        "evaluation_strategy",
        "metric_category",
        "metric_name",
        value.cast("decimal(5,4)").alias("metric_value"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("reasoning"),
        (F.col("event_id") % 29 == 0).alias("is_deleted"),
    )


def evaluation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return first_row_per_key(metric_candidates(spark, sf), METRIC_KEY, "event_id")


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest batch: documents whose label says good quality, in id order."""
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return documents(spark, sf).join(good, "doc_id", "left_semi").select(
        "doc_id", "doc_name", "text", F.array("lang", "source").alias("topics")
    )


def resident_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents already loaded before the ingest batch."""
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return documents(spark, sf).join(good, "doc_id", "left_anti")


def resident_of(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Rows of a per-document table that belong to resident documents."""
    return rows.join(resident_documents(spark, sf).select("doc_id"), "doc_id", "left_semi")


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Generated question/answer pairs; short ones carry the rejection marks."""
    return query_history(spark, sf).select(
        "query_id",
        (F.col("conv_id") % 4).alias("run_id"),
        F.when(F.length("question") < 40, F.concat(F.lit("INVALID_CHUNK "), "question"))
        .otherwise(F.col("question"))
        .alias("question"),
        F.when(F.length("generated_answer") < 100, "REJECTED")
        .otherwise(F.col("generated_answer"))
        .alias("answer"),
        F.when(F.col("turn") == 0, "Factoid").otherwise("Reasoning").alias("complexity"),
    )
