"""Approximate vector search over lists of near vectors.

Coarse centroids and the code books of a product quantiser are fitted on a bounded
sample. Every chunk vector is put into the list of its nearest centroid and written there
with a code of a few bytes, the difference to the centroid quantised in parts. A search
probes the lists whose centroids are nearest to a question: only their folders are read,
and of them only the codes. A task scores codes by look-ups in a table for each question
and keeps the best; these few are scored again with their exact vectors.

How many lists a question probes is found on the sample: the least number with which the
wanted share of the sample's own nearest neighbours is met, with a margin.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragassay.functions.vectors import comparable, matrix_of, normalised
from ragassay.schemas import SIMILARITY_THRESHOLD, TOP_K
from ragassay.session import checkpoint_folder, durable

#: vectors that fit the index, at most: what the driver holds (200 MB at 768 dimensions)
SAMPLE = 65_536
#: vectors that a list should have, lists at most
LIST_SIZE, MOST_LISTS = 4_096, 16_384
#: parts of a code, code words of a part, rounds of fitting
PARTS, CODEWORDS, ROUNDS = 8, 256, 8
#: sample vectors asked to find the number of probes; share of neighbours to be met
TRIALS, TARGET = 256, 0.97
#: candidates for each wanted chunk that are scored again exactly
REFINE = 20
#: questions of one scan, and candidate rows (~100 bytes) that may be broadcast
BLOCK, SENT_ROWS = 4_096, 1_000_000


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each vector; the first of equals. In blocks of bounded size."""
    out = np.empty(len(vectors), np.int64)
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    step = max(1, 8_000_000 // max(1, len(centres)))
    for a in range(0, len(vectors), step):
        out[a : a + step] = np.argmax(vectors[a : a + step] @ centres.T - half, axis=1)
    return out


def fitted(vectors: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centres of the vectors; centres without vectors move to far ones."""
    r = np.random.default_rng(seed)
    centres = vectors[r.choice(len(vectors), size=min(k, len(vectors)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(vectors, centres)
        sizes = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        full = sizes > 0
        centres[full] = np.add.reduceat(vectors[order], starts[full], axis=0) / sizes[full, None]
        if not full.all():
            far = np.argsort(-((vectors - centres[own]) ** 2).sum(axis=1), kind="stable")
            centres[~full] = vectors[far[: int((~full).sum())]]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Centres of the lists, code books (parts x code words x dimensions of a part)."""

    centres: np.ndarray
    books: np.ndarray

    def coded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each unit vector, and its code."""
        own = nearest(unit, self.centres)
        rest = self._split(unit - self.centres[own])
        codes = [nearest(rest[:, p], self.books[p]) for p in range(len(self.books))]
        return own, np.stack(codes, axis=1).astype(np.uint8) if codes else np.empty((len(unit), 0), np.uint8)

    def _split(self, rest: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        padded = np.zeros((len(rest), parts * width))
        padded[:, : rest.shape[1]] = rest
        return padded.reshape(len(rest), parts, width)

    def look_ups(self, questions: np.ndarray) -> np.ndarray:
        """Share of every code word in a score (questions x parts x code words)."""
        return np.einsum("qpw,pcw->qpc", self._split(questions), self.books)

    def probes(self, questions: np.ndarray, n: int) -> np.ndarray:
        """The n lists nearest to each question, nearest first."""
        half = 0.5 * np.einsum("ij,ij->i", self.centres, self.centres)
        return np.argsort(half - questions @ self.centres.T, axis=1, kind="stable")[:, :n]


_FITTED = "name string, n_probes int, schema string, shape array<int>, values array<double>"


@dataclass(frozen=True)
class VectorIndex:
    folder: str
    vectors: DataFrame
    quantiser: Quantiser
    n_probes: int


def sampled(chunks: DataFrame, size: int) -> np.ndarray:
    """Unit vectors of at most size chunks, those with the smallest hashes of their ids."""
    known = chunks.filter("embedding IS NOT NULL")
    n = known.count()
    if n > size:
        # a share first, so that few rows are sorted
        share = min(1.0, 1.2 * size / n + 0.001)
        known = known.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(size).select("embedding").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1))
    unit = normalised(matrix_of(rows["embedding"]))
    return unit[~np.isnan(unit).any(axis=1)]


def _needed_probes(sample: np.ndarray, quantiser: Quantiser, k: int, target: float) -> int:
    """Lists a question has to probe to meet its k nearest among the sample."""
    step = max(1, len(sample) // TRIALS)
    asked = sample[::step][:TRIALS]
    own = nearest(sample, quantiser.centres)
    order = quantiser.probes(asked, len(quantiser.centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    at = []
    for q, ranks in zip(asked, place, strict=True):
        scores = sample @ q
        scores[scores > 1 - 1e-9] = -2  # the vector itself and its copies lie in its own list
        best = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
        at += ranks[own[best]].tolist()
    return min(len(quantiser.centres), int(np.quantile(at, target, method="higher")) + 2) if at else 1


def build_index(
    chunks: DataFrame,
    folder: str | None = None,
    *,
    list_size: int = LIST_SIZE,
    sample: int = SAMPLE,
    target: float = TARGET,
    k: int = TOP_K,
    seed: int = 0,
) -> VectorIndex:
    """Fit the quantiser and write all chunks (chunk_id, doc_id, embedding) below folder.

    Chunks without a vector, or with one of length zero, are not searched and left out. A
    list that holds a large part of all vectors is written by many tasks and read by as
    many: rows are dealt by list and by the hash of their id.
    """
    spark = chunks.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/ragassay/{uuid.uuid4()}"
    unit = sampled(chunks, sample)
    n = chunks.filter("embedding IS NOT NULL").count()
    lists = max(1, min(MOST_LISTS, math.ceil(n / list_size), len(unit)))
    if len(unit):
        centres = fitted(unit, lists, seed)
        rest = unit - centres[nearest(unit, centres)]
        width = -(-unit.shape[1] // PARTS)
        parts = -(-unit.shape[1] // width)
        empty = Quantiser(centres, np.zeros((parts, 1, width)))
        split = empty._split(rest)
        words = min(CODEWORDS, len(unit))
        books = np.stack([fitted(split[:, p], words, seed + 1 + p) for p in range(parts)])
        quantiser = Quantiser(centres, books)
    else:
        quantiser = Quantiser(np.zeros((0, 1)), np.zeros((0, 1, 1)))  # nothing to search
    sent = spark.sparkContext.broadcast(quantiser)
    kinds = {c: chunks.schema[c].dataType for c in ("chunk_id", "doc_id")}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())
    schema += ", embedding array<float>, code binary, list int"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = normalised(matrix_of(batch.column("embedding")))
            fine = np.flatnonzero(~np.isnan(unit).any(axis=1))
            if not len(fine):
                continue
            own, codes = sent.value.coded(unit[fine])
            part = batch.take(pa.array(fine))
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: part.column(c) for c in ("chunk_id", "doc_id", "embedding")},
                    "code": pa.array([c.tobytes() for c in codes], pa.binary()),
                    "list": own.astype(np.int32),
                }
            )

    known = chunks.filter("embedding IS NOT NULL").select(
        "chunk_id", "doc_id", F.col("embedding").cast("array<float>").alias("embedding")
    )
    placed = known.mapInArrow(coded, schema)
    placed = placed.repartitionByRange("list", F.xxhash64("chunk_id")).sortWithinPartitions("list", "chunk_id")
    placed.write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    n_probes = _needed_probes(unit, quantiser, k, target) if len(unit) else 1
    # written last: what is open has all its lists
    parts = [("centres", quantiser.centres), ("books", quantiser.books)]
    rows = [(name, n_probes, schema, list(a.shape), a.ravel().tolist()) for name, a in parts]
    spark.createDataFrame(rows, _FITTED).write.mode("overwrite").parquet(f"{folder}/fitted")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    """An index that build_index has written."""
    rows = {r["name"]: r for r in spark.read.schema(_FITTED).parquet(f"{folder}/fitted").collect()}
    centres, books = (np.array(rows[n]["values"]).reshape(rows[n]["shape"]) for n in ("centres", "books"))
    vectors = spark.read.schema(rows["centres"]["schema"]).parquet(f"{folder}/lists")
    return VectorIndex(folder, vectors, Quantiser(centres, books), rows["centres"]["n_probes"])


def _candidates(index: VectorIndex, ids: pa.Array, unit: np.ndarray, keep: int, n_probes: int) -> DataFrame:
    """query_id, chunk_id, list, about: the best `keep` codes of each question and task."""
    spark = index.vectors.sparkSession
    probes = index.quantiser.probes(unit, n_probes)
    wanted = np.unique(probes).tolist()
    asked_by: dict[int, np.ndarray] = {c: np.flatnonzero((probes == c).any(axis=1)) for c in wanted}
    tables = index.quantiser.look_ups(unit).astype(np.float32)
    base = (unit @ index.quantiser.centres.T).astype(np.float32)
    sent = spark.sparkContext.broadcast((ids, asked_by, tables, base))
    id_type = "bigint" if pa.types.is_integer(ids.type) else "string"
    chunk_type = index.vectors.schema["chunk_id"].dataType
    schema = f"query_id {id_type}, chunk_id {chunk_type.simpleString()}, list int, about float"
    arrow = pa.schema(
        [("query_id", ids.type), ("chunk_id", to_arrow_type(chunk_type)), ("list", pa.int32()), ("about", pa.float32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked_by, tables, base = sent.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        size = 0
        for batch in batches:
            own = batch.column("list").to_numpy()
            for c in np.unique(own).tolist():
                at = np.flatnonzero(own == c)
                part = batch.take(pa.array(at))
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(at), -1)
                for q in asked_by[c].tolist():
                    scores = base[q, c] + tables[q][np.arange(codes.shape[1]), codes].sum(axis=1)
                    top = np.argsort(-scores, kind="stable")[:keep]
                    held.append((np.full(len(top), q), scores[top], np.full(len(top), c), part.column("chunk_id").take(pa.array(top))))
                    size += len(top)
                    if size > 4 * keep * len(ids) + 100_000:
                        held = [best_of(held)]
                        size = len(held[0][0])
        if held:
            query, scores, lists, chunk = best_of(held)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(query)), chunk, pa.array(lists, pa.int32()), pa.array(scores, pa.float32())], schema=arrow
            )

    def best_of(held: list[tuple]) -> tuple:
        query, scores, lists = (np.concatenate([h[n] for h in held]) for n in range(3))
        chunk = pa.concat_arrays([h[3] for h in held])
        order = np.lexsort((-scores, query))
        firsts = np.searchsorted(query[order], query[order], side="left")
        top = order[np.arange(len(order)) - firsts < keep]
        return query[top], scores[top], lists[top], chunk.take(pa.array(top))

    codes = index.vectors.filter(F.col("list").isin(wanted)).select("chunk_id", "list", "code")
    return codes.mapInArrow(run, schema)


def approximate_search(
    index: VectorIndex,
    questions: DataFrame,
    top_k: int = TOP_K,
    threshold: float = SIMILARITY_THRESHOLD,
    n_probes: int | None = None,
    refine: int = REFINE,
) -> DataFrame:
    """Top-k chunks per question (query_id, embedding): query_id, rank_no, chunk_id, doc_id,
    similarity_score.

    Scores are exact; equal ones rank by chunk_id. Chunks below the threshold are left out.
    Questions are sent in blocks of a bounded number, one scan of their lists each.
    """
    known = questions.filter("embedding IS NOT NULL")
    n = known.count() if len(index.quantiser.centres) else 0
    blocks = max(1, -(-n // BLOCK))
    found = []
    for b in range(blocks if n else 0):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.select("query_id", "embedding").toArrow()
        if not rows.num_rows:
            continue
        unit = normalised(matrix_of(rows["embedding"]))
        fine = ~np.isnan(unit).any(axis=1)
        ids = rows["query_id"].combine_chunks().filter(pa.array(fine))
        if not len(ids):
            continue
        found.append(_refined(index, ids, unit[fine], top_k, threshold, n_probes or index.n_probes, refine))
    if not found:
        return index.vectors.limit(0).select(
            F.lit(None).cast(questions.schema["query_id"].dataType).alias("query_id"),
            F.lit(1).cast("bigint").alias("rank_no"), "chunk_id", "doc_id", F.lit(0.0).alias("similarity_score"),
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _refined(
    index: VectorIndex, ids: pa.Array, unit: np.ndarray, k: int, threshold: float, n_probes: int, refine: int
) -> DataFrame:
    """The candidates of one block of questions, scored with their exact vectors."""
    spark = index.vectors.sparkSession
    keep = k * refine
    best = Window.partitionBy("query_id").orderBy(F.desc("about"), "chunk_id")
    rows = _candidates(index, ids, unit, keep, n_probes).withColumn("no", F.row_number().over(best))
    few = durable(rows.filter(F.col("no") <= keep).select("query_id", "chunk_id", "list"))
    wanted = [r["list"] for r in few.select("list").distinct().collect()]  # one row for each list
    sent = F.broadcast(few) if len(ids) * keep <= SENT_ROWS else few
    vectors = index.vectors.filter(F.col("list").isin(wanted)).select("chunk_id", "doc_id", "list", "embedding")
    met = vectors.join(sent, ["list", "chunk_id"])
    asked = spark.sparkContext.broadcast((ids, unit))
    doc_type, chunk_type = (index.vectors.schema[c].dataType for c in ("doc_id", "chunk_id"))
    id_type = "bigint" if pa.types.is_integer(ids.type) else "string"
    schema = (
        f"query_id {id_type}, chunk_id {chunk_type.simpleString()}, doc_id {doc_type.simpleString()}, "
        "similarity_score double, order_score double"
    )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = asked.value
        row_of = {q: n for n, q in enumerate(ids.to_pylist())}
        for batch in batches:
            if batch.num_rows:
                own = unit[[row_of[q] for q in batch.column("query_id").to_pylist()]]
                scores = np.einsum("ij,ij->i", normalised(matrix_of(batch.column("embedding"))), own)
                yield pa.RecordBatch.from_pydict(
                    {
                        **{c: batch.column(c) for c in ("query_id", "chunk_id", "doc_id")},
                        "similarity_score": scores,
                        "order_score": comparable(scores),
                    }
                )

    scored = met.select("query_id", "chunk_id", "doc_id", "embedding").mapInArrow(exact, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("order_score"), "chunk_id")
    ranked = scored.filter(F.col("order_score") >= threshold).withColumn("rank_no", F.row_number().over(order))
    return ranked.filter(F.col("rank_no") <= k).select(
        "query_id", F.col("rank_no").cast("bigint").alias("rank_no"), "chunk_id", "doc_id", "similarity_score"
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, n_exact, recall: the share of each question's exact result that was found.

    A found chunk counts too if it is as similar as the last exact one, for equal vectors.
    """
    last = exact.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_exact"), F.min("similarity_score").alias("least")
    )
    hits = found.join(last, "query_id", "right").groupBy("query_id", "n_exact").agg(
        F.count_if(F.col("similarity_score") >= F.col("least") - 1e-9).alias("hits")
    )
    share = F.least("hits", "n_exact") / F.col("n_exact")
    return hits.select("query_id", "n_exact", share.alias("recall"))
