"""From documents to chunk rows, and the versioned load of an ingest batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.functions.arrays import exploded
from ragassay.functions.chunking import chunk_pages
from ragassay.functions.text import base_name, is_not_blank, json_text_or_null, name_uuid, stable_id
from ragassay.operators.retrieve import active
from ragassay.schemas import CHUNK_OVERLAP, CHUNK_SIZE, CHUNKING_STRATEGY


def fingerprint(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Document name and MD5 of the raw bytes."""
    return files.withColumns(
        {"document_name": base_name(F.col(path)), "md5_hash": F.md5(F.col(content))}
    )


def explode_pages(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """One row per page; blank pages are dropped but keep their number."""
    rest = [c for c in documents.columns if c != pages]
    rows = exploded(documents, pages, rest, "page_text", "_pos")
    return rows.filter(is_not_blank(F.col("page_text"))).select(
        *rest, (F.col("_pos") + 1).alias("page_number"), "page_text"
    )


def explode_pieces(documents: DataFrame, pieces: Column) -> DataFrame:
    """Chunk rows from each document's pieces per page.

    The position in the flattened array is the document-wide chunk index, so
    numbering needs neither a shuffle nor a window over the document.
    """
    rest = documents.columns

    def page(texts: Column, position: Column) -> Column:
        return F.transform(
            texts, lambda t: F.struct((position + 1).alias("page_number"), t.alias("content"))
        )

    flat = F.flatten(F.transform(pieces, page))
    rows = exploded(documents, flat, rest, "_piece", "chunk_index")
    return rows.select(*rest, "chunk_index", "_piece.page_number", "_piece.content")


def chunk_documents(
    documents: DataFrame,
    pages: str = "pages",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Recursive character chunks of every page of every document."""
    split = documents.withColumn("_pieces", chunk_pages(size, overlap)(F.col(pages)))
    return explode_pieces(split.drop(pages), F.col("_pieces")).drop("_pieces")


def page_pieces(pages: Column) -> Column:
    """Pieces when every non-blank page is one chunk."""
    return F.transform(
        pages,
        lambda p: F.when(is_not_blank(p), F.array(p)).otherwise(F.array().cast("array<string>")),
    )


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Stored form of a chunk: id, strategy and page metadata."""
    return chunks.withColumns(
        {
            "id": stable_id(F.col("doc_id"), F.col("chunk_index")),
            "chunking_strategy": F.lit(CHUNKING_STRATEGY),
            "metadata": F.struct(
                F.col("page_number").cast("int").alias("page_number"),
                F.lit(None).cast("int").alias("token_count"),
            ),
        }
    )


def chunk_metadata_json(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("metadata", json_text_or_null(F.col("metadata")))


# --- versioned load ------------------------------------------------------------


def retired_documents(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Active documents that an incoming name replaces: (doc_id, doc_name)."""
    names = incoming.select("doc_name").distinct()
    return active(documents).select("doc_id", "doc_name").join(names, "doc_name", "left_semi")


def soft_deleted(rows: DataFrame, retired: DataFrame) -> DataFrame:
    """Next state of a table that belongs to documents: documents, chunks, topic rows.

    Active rows of a retired document become deleted; ``newly_deleted`` tells
    which they were. Rows already deleted, or without a flag, stay as they are.
    """
    gone = retired.select("doc_id", F.lit(True).alias("_gone"))
    now = F.coalesce(F.col("_gone") & (F.col("is_deleted") == F.lit(False)), F.lit(False))
    return (
        rows.join(gone, "doc_id", "left")
        .withColumn("newly_deleted", now)
        .withColumn("is_deleted", F.when(F.col("newly_deleted"), True).otherwise(F.col("is_deleted")))
        .select(*rows.columns, "newly_deleted")
    )


def with_superseded_flag(arrivals: DataFrame, order: str) -> DataFrame:
    """Within one batch only the last arrival of a name stays active.

    Same outcome as loading the batch one document after the other. The last
    arrival per name is a partial aggregate, so a name shared by a third of
    the batch does not gather in one task.
    """
    last = arrivals.groupBy("doc_name").agg(F.max(order).alias("_last"))
    joined = arrivals.join(last, "doc_name")
    return joined.withColumn("is_deleted", F.col(order) < F.col("_last")).drop("_last")


def new_document_versions(arrivals: DataFrame, order: str = "doc_id") -> DataFrame:
    """Document rows for the batch; identity is the name, the MD5 is only kept."""
    return with_superseded_flag(arrivals, order)


def with_text(arrivals: DataFrame, pages: str = "pages") -> DataFrame:
    """Documents that give at least one chunk; the others are not loaded at all."""
    return arrivals.filter(F.exists(pages, is_not_blank))


def topics_upsert(topics: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new topic names, revive listed ones, keep the rest as they are."""
    new = incoming.select(
        name_uuid(F.col("topic_name")).alias("topic_id"), F.col("topic_name").alias("_name")
    ).distinct()
    joined = topics.join(new, "topic_id", "full_outer")
    listed = F.col("_name").isNotNull()
    return joined.select(
        "topic_id",
        F.coalesce("topic_name", "_name").alias("topic_name"),
        F.when(listed, False).otherwise(F.col("is_deleted")).alias("is_deleted"),
        (listed & F.col("topic_name").isNull()).alias("was_inserted"),
    )


def checked_topics(topics: Column) -> Column:
    """A topic named twice for one document breaks the mapping key: fail the load.

    No topics at all is an empty list.
    """
    topics = F.coalesce(topics, F.array().cast("array<string>"))
    return F.when(
        F.size(F.array_distinct(topics)) == F.size(topics), topics
    ).otherwise(F.raise_error(F.lit("a document lists the same topic twice")))


def document_topics_map(arrivals: DataFrame) -> DataFrame:
    named = exploded(arrivals, checked_topics(F.col("topics")), ["doc_id"], "topic_name")
    return named.select("doc_id", name_uuid(F.col("topic_name")).alias("topic_id"))


def ingest_stats(
    retired: DataFrame,
    chunks: DataFrame,
    document_topics: DataFrame,
    versions: DataFrame,
    topics: DataFrame,
    chunk_counts: DataFrame,
    order: str = "doc_id",
) -> DataFrame:
    """Counts per document name, as if the batch was loaded in arrival order.

    ``chunks``, ``document_topics`` and ``topics`` are the tables before the
    load; ``versions`` are the arrivals with ``is_deleted`` and ``topics``;
    ``chunk_counts`` is (doc_id, n_chunks) of the arrivals. A topic counts as
    inserted for the first arrival that brings it.
    """

    ids = retired.select("doc_id")

    def lost(rows: DataFrame, out: str) -> DataFrame:
        # rows of other documents leave first; then counted per document, as one
        # document may own most of the rows
        mine = active(rows).select("doc_id").join(ids, "doc_id", "left_semi")
        return mine.groupBy("doc_id").agg(F.count("*").alias(out))

    gone = (
        retired.join(lost(chunks, "chunks_of"), "doc_id", "left")
        .join(lost(document_topics, "topics_of"), "doc_id", "left")
        .groupBy("doc_name")
        .agg(
            F.count("*").alias("deleted_documents"),
            F.sum("chunks_of").alias("deleted_chunks"),
            F.sum("topics_of").alias("deleted_topics"),
        )
    )
    first = (
        versions.select(order, "doc_name", F.explode("topics").alias("topic_name"))
        .groupBy("topic_name")
        .agg(F.min_by("doc_name", order).alias("doc_name"))
        .join(topics.select("topic_name"), "topic_name", "left_anti")
        .groupBy("doc_name")
        .agg(F.count("*").alias("inserted_topics"))
    )
    superseded = F.col("is_deleted")
    n = F.coalesce("n_chunks", F.lit(0))
    new = (
        versions.join(chunk_counts, "doc_id", "left")
        .groupBy("doc_name")
        .agg(
            F.count("*").alias("inserted_documents"),
            F.sum(F.size("topics")).alias("inserted_document_topics"),
            F.sum(n).alias("inserted_document_chunks"),
            F.count_if(superseded).alias("_docs"),
            F.sum(F.when(superseded, n).otherwise(0)).alias("_chunks"),
            F.sum(F.when(superseded, F.size("topics")).otherwise(0)).alias("_topics"),
        )
    )
    joined = new.join(gone, "doc_name", "left").join(first, "doc_name", "left")

    def total(kept: str, extra: str | None = None) -> Column:
        value = F.coalesce(F.col(kept), F.lit(0))
        return (value + F.col(extra) if extra else value).cast("bigint")

    return joined.select(
        "doc_name",
        total("deleted_documents", "_docs").alias("soft_deleted_documents"),
        total("deleted_chunks", "_chunks").alias("soft_deleted_document_chunks"),
        total("deleted_topics", "_topics").alias("soft_deleted_document_topics"),
        total("inserted_documents").alias("inserted_documents"),
        total("inserted_topics").alias("inserted_topics"),
        total("inserted_document_topics").alias("inserted_document_topics"),
        total("inserted_document_chunks").alias("inserted_document_chunks"),
    )
