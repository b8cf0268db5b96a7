"""Chunkers that follow the structure or the meaning of a text.

Both make all chunks of a document in one pass over its text, inside the task that reads
it; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragassay.functions.chunking import split_text
from ragassay.functions.embedding import Embedder, hashing_embedder
from ragassay.functions.sections import sections, windows
from ragassay.schemas import CHUNK_OVERLAP, CHUNK_SIZE

#: distances of neighbouring sentences above this percentile of their document part windows
PERCENTILE = 0.9
#: bytes of chunks handed on at a time
BATCH = 4_000_000


def _mapped(documents: DataFrame, names: list[tuple[str, str, pa.DataType]], of_text) -> DataFrame:
    """doc_id and the columns of what of_text makes of each text."""
    kind = documents.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t, _ in names)
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), *((n, t) for n, _, t in names)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for made in of_text(text or ""):
                    rows.append((doc_id, *made))
                    size += len(made[-1])
                    if size > BATCH:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def document_sections(documents: DataFrame) -> DataFrame:
    """doc_id, section_no (from 0), path (headings, outermost first), content of every
    section of documents (doc_id, text). Null and blank texts have none; a text without
    headings is one section with an empty path."""

    def of_text(text: str) -> Iterator[tuple]:
        for number, (path, body) in enumerate(sections(text)):
            yield number, path, body

    names = [
        ("section_no", "bigint", pa.int64()),
        ("path", "array<string>", pa.list_(pa.string())),
        ("content", "string", pa.string()),
    ]
    return _mapped(documents, names, of_text)


def chunk_sections(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_index, section_no, path, content: sections as chunks, those of more than
    size characters split like any text, within the section."""
    if overlap > size:
        raise ValueError(f"chunk overlap {overlap} is larger than chunk size {size}")

    def of_text(text: str) -> Iterator[tuple]:
        index = 0
        for number, (path, body) in enumerate(sections(text)):
            for piece in [body] if len(body) <= size else split_text(body, size, overlap):
                yield index, number, path, piece
                index += 1

    names = [
        ("chunk_index", "bigint", pa.int64()),
        ("section_no", "bigint", pa.int64()),
        ("path", "array<string>", pa.list_(pa.string())),
        ("content", "string", pa.string()),
    ]
    return _mapped(documents, names, of_text)


def chunk_semantic(
    documents: DataFrame,
    embed: Embedder | None = None,
    percentile: float = PERCENTILE,
    longest: int = CHUNK_SIZE,
) -> DataFrame:
    """doc_id, chunk_index, content: windows of sentences that belong together.

    A window ends where the distance to the next sentence is above that percentile of all
    neighbours' distances in the document, or before it exceeds longest characters; a longer
    sentence is a window of its own.
    """
    model = embed or hashing_embedder()

    def of_text(text: str) -> Iterator[tuple]:
        yield from enumerate(windows(text, model, percentile, longest))

    return _mapped(documents, [("chunk_index", "bigint", pa.int64()), ("content", "string", pa.string())], of_text)
