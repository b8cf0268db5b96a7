"""Batch embedding stage with a pluggable model and in-task retry."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ragassay.schemas import EMBEDDING_ATTEMPTS, EMBEDDING_BATCH, EMBEDDING_DIMENSION

Embedder = Callable[[list[str], str], np.ndarray]

_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def _code(word: str) -> int:
    """32 bits of the word's MD5: the same on every machine and in SQL."""
    return int.from_bytes(hashlib.md5(word.encode("utf-8")).digest()[:4], "big")


def hashing_embedder(dimension: int = EMBEDDING_DIMENSION) -> Embedder:
    """Deterministic default model: signed feature hashing, L2-normalised."""

    def embed(texts: list[str], task: str) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            codes = np.fromiter((_code(w) for w in _WORD.findall(text.lower())), dtype=np.int64)
            sign = 1.0 - 2.0 * ((codes >> 31) & 1)
            row += np.bincount(codes % dimension, weights=sign, minlength=dimension)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0.0, 1.0, norms)).astype(np.float32)

    return embed


def call_with_retry(
    embed: Embedder,
    texts: list[str],
    task: str,
    attempts: int = EMBEDDING_ATTEMPTS,
    wait_seconds: tuple[float, float] = (2.0, 10.0),
) -> np.ndarray:
    """Exponential wait between attempts; the last failure fails the task."""
    low, high = wait_seconds
    for attempt in range(1, attempts + 1):
        try:
            vectors = embed(texts, task)
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(min(high, low * 2 ** (attempt - 1)))
        else:
            if len(vectors) != len(texts):
                raise ValueError(f"model returned {len(vectors)} vectors for {len(texts)} texts")
            return np.asarray(vectors, dtype=np.float32)
    raise ValueError("attempts must be positive")


def embed_texts(
    embed: Embedder | None = None,
    task: str = "document",
    batch_size: int = EMBEDDING_BATCH,
    attempts: int = EMBEDDING_ATTEMPTS,
    wait_seconds: tuple[float, float] = (2.0, 10.0),
) -> Callable[[Column], Column]:
    """Column function text -> ``array<float>``; null texts stay null."""
    model = embed or hashing_embedder()

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for start in range(0, len(texts), batch_size):
                group = texts.slice(start, batch_size)
                known = group.drop_null().to_pylist()
                vectors = call_with_retry(model, known, task, attempts, wait_seconds) if known else []
                parts.append(_as_lists(vectors, group))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return run


def _as_lists(vectors: np.ndarray, texts: pa.Array) -> pa.Array:
    """One list per text; a null text takes no values and is marked null."""
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    width = vectors.shape[1] if len(vectors) else 0
    ends = np.concatenate([[0], np.cumsum(valid * width)]).astype(np.int32)
    values = pa.array(np.ravel(vectors).astype(np.float32))
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=mask)
