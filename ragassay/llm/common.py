"""Helpers shared by the text operators: input columns, durable tables, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.session import durable

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: bytes hashed at a time, so that a very long text needs no arrays of its length in powers
BLOCK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

__all__ = ["durable"]


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) with a fresh frame around them.

    Only the named columns are read, so further columns of any name do no harm.
    """
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting both sides, for tables that grow with the documents.

    Whether a small input would let one side be sent to every task plays no part: the plan
    is the same at every size, and a crowded key can be split.
    """
    return left.join(right.hint("merge"), on, how)


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z only."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_rows(
    df: DataFrame, schema: str, of_row: Callable[..., Iterator[tuple]]
) -> DataFrame:
    """Emit any number of rows for each row of df; of_row gets the columns in order."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    rows.extend(of_row(*values))
                size += part.nbytes
                if len(rows) > 20_000 or size > 16_000_000:
                    yield _batch(rows, arrow)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in arrow)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
    )


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept up to a few blocks."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        made = []
        for base in (BASE, INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table))
        if size > 4 * BLOCK:
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for many spans, from one prefix sum.

    Equal spans hash alike wherever they stand.
    """
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    spans = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(spans ^ (ends - starts).astype(np.uint64))


def words(text: str, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of the words (runs without ASCII white space)."""
    data = np.frombuffer(text.encode(), np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    fence = np.ones(len(data) + 2, np.int8)
    fence[1:-1] = SPACE[data]
    edges = np.flatnonzero(np.diff(fence))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        low, high = starts[first], ends[last - 1]
        hashes[first:last] = span_hashes(
            data[low:high].astype(np.uint64) + np.uint64(1),
            starts[first:last] - low,
            ends[first:last] - low,
        )
        first = last
    return starts, ends, hashes


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return span_hashes(hashes, at, at + k)


def window_minima(order: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest value in each window; the leftmost of equal ones."""
    n = len(order) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(order))
    width = 1
    while width < window:
        step = min(width, window - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(order[right] < order[left], right, left)
        width += step
    return best[:n]


def signed(h: np.ndarray) -> list[int]:
    """Hashes as the signed 64-bit integers that Spark has."""
    return h.view(np.int64).tolist()
