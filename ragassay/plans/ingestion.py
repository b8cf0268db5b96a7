"""Load a batch of documents: chunk, embed, retire old versions, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragassay.functions.embedding import Embedder, embed_texts
from ragassay.functions.text import name_uuid, stable_id
from ragassay.operators import ingest
from ragassay.schemas import CHUNK_OVERLAP, CHUNK_SIZE
from ragassay.session import durable, ship_package
from ragassay.sources import store


def ingest_documents(
    spark: SparkSession,
    root: str,
    documents: DataFrame,
    *,
    embed: Embedder | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    by: str = "automated_ingestion_pipeline",
) -> DataFrame:
    """Load documents (document_name, file_path, md5_hash, total_pages, pages, topics).

    Returns the counts per document name. A document without any text is left
    out entirely and keeps its old version; null or missing topics are none. Chunks
    are written once and counted from the written files, so nothing is embedded twice.
    """
    ship_package(spark)
    base = store.current_version(spark, root)
    topics = F.col("topics") if "topics" in documents.columns else F.lit(None)
    # written once: the number keeps apart rows of one file, in the texts and in the
    # headers, which only read their own columns
    loaded = durable(
        ingest.with_text(documents).select(
            F.col("document_name").alias("doc_name"),
            F.struct("file_path", F.monotonically_increasing_id().alias("number")).alias("arrival"),
            "file_path",
            "md5_hash",
            "total_pages",
            "pages",
            ingest.checked_topics(topics.cast("array<string>")).alias("topics"),
        )
    )
    identity = stable_id(
        F.lit(base + 1), F.col("file_path"), F.col("md5_hash"), F.col("arrival.number")
    )
    loaded = loaded.withColumn("doc_id", identity)
    chunks = ingest.chunk_documents(loaded.select("doc_id", "pages"), "pages", size, overlap)
    embedded = ingest.chunk_rows(chunks).withColumn("embedding", embed_texts(embed)("content"))
    chunk_part = store.write_part(embedded, root, "document_chunks", by)
    headers = durable(loaded.drop("pages"))
    versions = durable(ingest.new_document_versions(headers, order="arrival"))

    # every arrival is written as active; the ones superseded inside this batch
    # join the retired ids, so vectors never take part in a join
    metadata = F.struct("file_path", "total_pages", "md5_hash").alias("metadata")
    document_part = store.write_part(
        headers.select("doc_id", "doc_name", metadata), root, "documents", by
    )
    topic_part = store.write_part(
        ingest.document_topics_map(headers), root, "document_topics", by
    )
    retired = durable(
        ingest.retired_documents(store.read(spark, root, "documents", base), headers)
    )
    superseded = versions.filter("is_deleted").select("doc_id")
    retired_part = store.write_part(
        retired.select("doc_id").unionByName(superseded), root, store.RETIRED, by
    )
    old_topics = store.read(spark, root, "topics", base)
    incoming = headers.select(F.explode("topics").alias("topic_name"))
    topics = ingest.topics_upsert(
        old_topics.select("topic_id", "topic_name", "is_deleted"), incoming
    )
    audit = old_topics.select("topic_id", "created_by", "created_at", "updated_by", "updated_at")
    listed = incoming.select(name_uuid(F.col("topic_name")).alias("topic_id")).distinct()
    revived = F.col("_listed") & ~F.col("was_inserted")
    topics_part = store.write_part(
        topics.join(audit, "topic_id", "left")
        .join(listed.withColumn("_listed", F.lit(True)), "topic_id", "left")
        .withColumns(
            {
                "created_by": F.coalesce("created_by", F.lit(by)),
                "created_at": F.coalesce("created_at", F.localtimestamp()),
                # only topics that this batch lists are touched
                "updated_by": F.when(revived, by).otherwise(F.col("updated_by")),
                "updated_at": F.when(revived, F.localtimestamp()).otherwise(
                    F.coalesce("updated_at", F.localtimestamp())
                ),
            }
        ),
        root,
        "topics",
        by,
    )
    store.publish(
        spark,
        root,
        base,
        append={
            "documents": [document_part],
            "document_topics": [topic_part],
            "document_chunks": [chunk_part],
            store.RETIRED: [retired_part],
        },
        replace={"topics": [topics_part]},
    )
    counts = (
        store.read_part(
            spark, root, "document_chunks", spark.createDataFrame([(chunk_part,)], "load string")
        )
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_chunks"))
    )
    return ingest.ingest_stats(
        retired,
        store.read(spark, root, "document_chunks", base),
        store.read(spark, root, "document_topics", base),
        versions,
        old_topics,
        counts,
        order="arrival",
    )
