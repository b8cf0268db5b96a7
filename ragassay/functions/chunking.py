"""Recursive character chunking of page texts.

Separators stay at the start of the piece that follows them, so every piece is
a slice of the page and a chunk is a pair of offsets into it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ragassay.schemas import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_SIZE


def _piece_bounds(text: str, lo: int, hi: int, separator: str) -> Sequence[int]:
    """Offsets where pieces begin, closed by ``hi``; no separator cuts everywhere."""
    if not separator:
        return range(lo, hi + 1)
    bounds = [lo]
    at = text.find(separator, lo, hi)
    while at != -1:
        if at > lo:
            bounds.append(at)
        at = text.find(separator, at + len(separator), hi)
    bounds.append(hi)
    return bounds


def _packed(text: str, bounds: Sequence[int], size: int, overlap: int) -> Iterator[str]:
    """Slide a window over consecutive pieces, each shorter than ``size``.

    A window takes as many pieces as fit. The next one starts at the first piece
    that leaves at most ``overlap`` characters of it and room for one more piece.
    Windows come out stripped, blank ones not at all.
    """
    head, last = 0, len(bounds) - 1
    while head < last:
        end = bisect_right(bounds, bounds[head] + size) - 1
        if window := text[bounds[head] : bounds[end]].strip():
            yield window
        if end == last:
            return
        keep_from = max(bounds[end] - overlap, bounds[end + 1] - size)
        head = bisect_left(bounds, keep_from, head, end)


def _chunks(
    text: str, lo: int, hi: int, separators: tuple[str, ...], size: int, overlap: int
) -> Iterator[str]:
    used = next(
        (i for i, s in enumerate(separators) if not s or text.find(s, lo, hi) != -1),
        len(separators) - 1,
    )
    finer = separators[used + 1 :]
    bounds = _piece_bounds(text, lo, hi, separators[used])
    if not separators[used] and size > 1:
        yield from _packed(text, bounds, size, overlap)
        return
    run = [lo]
    for start, end in zip(bounds, bounds[1:]):
        if end - start < size:
            run.append(end)
            continue
        yield from _packed(text, run, size, overlap)
        if finer:
            yield from _chunks(text, start, end, finer, size, overlap)
        else:
            yield text[start:end]
        run = [end]
    yield from _packed(text, run, size, overlap)


def split_text(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = CHUNK_SEPARATORS,
) -> list[str]:
    return list(_chunks(text, 0, len(text), separators, size, overlap))


def chunk_pages(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Callable[[Column], Column]:
    """Column function ``array<string>`` of pages -> ``array<array<string>>`` of chunks."""
    if overlap > size:
        raise ValueError(f"chunk overlap {overlap} is larger than chunk size {size}")
    out = pa.list_(pa.list_(pa.string()))

    @F.arrow_udf("array<array<string>>")
    def run(pages: pa.Array) -> pa.Array:
        split = [
            None if doc is None else [split_text(page, size, overlap) if page else [] for page in doc]
            for doc in pages.to_pylist()
        ]
        return pa.array(split, type=out)

    return run
