"""Similarity kernel run inside each scan task: one block of queries against
Arrow batches of chunk vectors, with a running top-k per query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# cells of one score matrix held at a time (64 MB of doubles)
SCORE_CELLS = 8_000_000
# scores are compared (not reported) at 12 places: the last bits of a dot product
# depend on where a row sits in its batch, and equal vectors must tie
SCORE_PLACES = 12


def comparable(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, SCORE_PLACES)


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Unit rows in double precision; a zero vector has no direction and gives NaN."""
    wide = np.asarray(vectors, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """``list<float>`` column -> matrix; rows must share one dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) == 0:
        return np.zeros((0, 0))
    if lengths.min() != lengths.max():
        raise ValueError("vectors of one column must share their dimension")
    return flat.reshape(len(lengths), -1)


@dataclass(frozen=True)
class QueryBlock:
    """A bounded set of questions, ready to be broadcast."""

    ids: pa.Array
    unit: np.ndarray
    threshold: np.ndarray
    top_k: np.ndarray | None = None
    topics: list[list[str] | None] = field(default_factory=list)

    @property
    def wanted_topics(self) -> list[str]:
        return sorted({t for names in self.topics if names for t in names if t is not None})

    @property
    def any_filtered(self) -> bool:
        return any(self.topics)

    @property
    def all_filtered(self) -> bool:
        return bool(self.topics) and all(self.topics)


def _topic_matrix(topics: pa.Array, names: list[str]) -> np.ndarray:
    """How often each chunk's document carries each wanted topic."""
    lengths = pc.fill_null(pc.list_value_length(topics), 0).to_numpy()
    row = np.repeat(np.arange(len(topics)), lengths)
    slot = pc.fill_null(pc.index_in(topics.flatten(), value_set=pa.array(names, pa.string())), -1)
    slot = slot.to_numpy()
    has = np.zeros((len(topics), len(names)))
    np.add.at(has, (row[slot >= 0], slot[slot >= 0]), 1)
    return has


def _topic_counts(
    has: np.ndarray, block: QueryBlock, cols: slice, distinct: bool
) -> np.ndarray | None:
    """How often a chunk satisfies each query's topic filter (1 without a filter)."""
    filters = block.topics[cols]
    if not any(filters):
        return None
    slot = {name: i for i, name in enumerate(block.wanted_topics)}
    asks = np.zeros((len(slot), len(filters)))
    for col, names in enumerate(filters):
        for name in {n for n in names or () if n is not None}:
            asks[slot[name], col] = 1
    counts = has @ asks
    counts[:, [i for i, names in enumerate(filters) if not names]] = 1
    return np.minimum(counts, 1) if distinct else counts


def _best(query, score, key, k):
    """Positions of the k best rows of each query; ties go to the smaller key."""
    order = np.lexsort((key, -score, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k[q]]


def _sortable(ids: pa.Array) -> np.ndarray:
    """Integers in id order; text ids rank by bytes, as Spark orders strings."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy()
    return pc.rank(ids, tiebreaker="dense").to_numpy()


def similarity_hits(
    block: QueryBlock,
    *,
    out_schema: pa.Schema,
    distinct_topics: bool = False,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function over (chunk_id, doc_id, embedding[, topics]).

    Without ``top_k`` every pair at or above the threshold is emitted batch by
    batch. With it a task keeps at most k chunks per query whatever it scans.
    """

    def hits_of(batch: pa.RecordBatch, floor: np.ndarray):
        vectors = matrix_of(batch.column("embedding"))
        if not len(vectors):
            return
        if vectors.shape[1] != block.unit.shape[1]:
            raise ValueError(
                f"chunk vectors have {vectors.shape[1]} dimensions, queries {block.unit.shape[1]}"
            )
        unit = normalised(vectors)
        has = None
        if "topics" in batch.schema.names:
            has = _topic_matrix(batch.column("topics"), block.wanted_topics)
        step = max(1, SCORE_CELLS // len(unit))
        for lo in range(0, len(block.ids), step):
            cols = slice(lo, lo + step)
            scores = unit @ block.unit[cols].T
            keep = scores >= floor[cols] - 10.0**-SCORE_PLACES
            counts = None
            if has is not None:
                counts = _topic_counts(has, block, cols, distinct_topics)
                if counts is not None:
                    keep &= counts > 0
            rows, col = np.nonzero(keep)
            picked = scores[rows, col]
            reach = comparable(picked) >= floor[cols][col]
            rows, col, picked = rows[reach], col[reach], picked[reach]
            copies = np.ones(len(rows), np.int64) if counts is None else counts[rows, col]
            yield rows, col + lo, picked, copies.astype(np.int64)

    def emit(query, chunk, doc, score, copies) -> pa.RecordBatch:
        limits = np.zeros(len(query), np.int64) if block.top_k is None else block.top_k[query]
        columns = [
            block.ids.take(pa.array(query)), chunk, doc,
            pa.array(score), pa.array(comparable(score)), pa.array(copies), pa.array(limits),
        ]
        return pa.RecordBatch.from_arrays(
            [c.cast(t) for c, t in zip(columns, out_schema.types)], schema=out_schema
        )

    def all_pairs(batches):
        for batch in batches:
            for rows, query, score, copies in hits_of(batch, block.threshold):
                at = pa.array(rows)
                yield emit(
                    query, batch.column("chunk_id").take(at), batch.column("doc_id").take(at),
                    score, copies,
                )

    def best_only(batches):
        held = None
        floor = block.threshold.copy()
        for batch in batches:
            for rows, query, score, copies in hits_of(batch, floor):
                if not len(rows):
                    continue
                at = pa.array(rows)
                new = (
                    query, batch.column("chunk_id").take(at), batch.column("doc_id").take(at),
                    score, copies,
                )
                if held is not None:
                    new = tuple(
                        pa.concat_arrays([a, b]) if isinstance(a, pa.Array) else np.concatenate([a, b])
                        for a, b in zip(held, new)
                    )
                top = _best(new[0], comparable(new[3]), _sortable(new[1]), block.top_k)
                held = tuple(c.take(pa.array(top)) if isinstance(c, pa.Array) else c[top] for c in new)
                # a full query only needs scores that reach its current k-th best
                full = np.bincount(held[0], minlength=len(floor)) >= block.top_k
                worst = np.full(len(floor), np.inf)
                np.minimum.at(worst, held[0], comparable(held[3]))
                floor = np.where(full & np.isfinite(worst), worst, block.threshold)
        if held is not None:
            yield emit(*held)

    return all_pairs if block.top_k is None else best_only
