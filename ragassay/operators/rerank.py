"""Reranking of a question's candidates: late interaction, then diversity.

Every token of a text has a vector. A chunk's relevance is the mean, over the tokens of the
question, of the largest cosine with any token of the chunk. Places are then dealt one by
one to the candidate with the best balance of relevance and distance from those that have
a place. A question has at most `candidates` chunks, which one task holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragassay.operators.retrieve import LOOKUP_ROWS
from ragassay.schemas import TOP_K

CANDIDATES = 50
#: weight of relevance against distance from the chunks chosen so far
BALANCE = 0.7
DIMENSION = 64

TokenEmbedder = Callable[[str], np.ndarray]
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def _token(word: str) -> tuple[float, ...]:
    vector = np.zeros(DIMENSION)
    marked = f"<{word}>"
    for i in range(len(marked) - 2):
        code = int.from_bytes(hashlib.md5(marked[i : i + 3].encode()).digest()[:4], "big")
        vector[code % DIMENSION] += 1 - 2 * (code >> 31)
    norm = np.linalg.norm(vector)
    return tuple(vector / norm if norm else vector)


def trigram_tokens(text: str) -> np.ndarray:
    """Default token vectors: signed hashed letter triples, so that words alike are near."""
    words = _WORD.findall(text.lower())
    return np.array([_token(w) for w in words]).reshape(len(words), DIMENSION)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norms == 0, 1.0, norms)


def late_interaction(question: np.ndarray, chunk: np.ndarray) -> float:
    if not len(question) or not len(chunk):
        return 0.0
    return float((_unit(question) @ _unit(chunk).T).max(axis=1).mean())


def diverse_order(relevance: np.ndarray, alike: np.ndarray, k: int, balance: float) -> list[tuple[int, float]]:
    """Chosen candidates with the value that chose them; the first of equals."""
    chosen: list[tuple[int, float]] = []
    nearest = np.full(len(relevance), 0.0)
    left = np.ones(len(relevance), bool)
    while left.any() and len(chosen) < k:
        value = np.where(left, np.round(balance * relevance - (1 - balance) * nearest, 12), -np.inf)
        at = int(value.argmax())
        chosen.append((at, float(value[at])))
        left[at] = False
        nearest = alike[at].copy() if len(chosen) == 1 else np.maximum(nearest, alike[at])
    return chosen


def with_texts(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Found rows with the content of their chunks (chunk_id, content).

    The found rows, counted, go to the chunks: the texts of all others stay where they are.
    """
    few = found.count() <= LOOKUP_ROWS
    return chunks.select("chunk_id", "content").join(F.broadcast(found) if few else found, "chunk_id")


def reranked(
    candidates: DataFrame,
    top_k: int = TOP_K,
    balance: float = BALANCE,
    most: int = CANDIDATES,
    embed: TokenEmbedder | None = None,
) -> DataFrame:
    """Places for candidates (query_id, question, rank_no, chunk_id, content).

    query_id, rank_no, chunk_id, first_rank, relevance, value. Only the first `most` ranks of
    a question are looked at. A null or wordless text has relevance 0 and is like no other.
    Equal values go by first rank, then chunk_id.
    """
    model = embed or trigram_tokens
    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")}

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank_no", "chunk_id"], kind="stable").reset_index(drop=True)
        asked = model(rows["question"][0] or "")
        found = [model(t or "") for t in rows["content"]]
        relevance = np.array([late_interaction(asked, f) for f in found])
        width = max(f.shape[1] if f.ndim == 2 else 1 for f in found)
        means = _unit(np.array([f.mean(axis=0) if len(f) else np.zeros(width) for f in found]))
        chosen = diverse_order(relevance, means @ means.T, top_k, balance)
        at = [i for i, _ in chosen]
        return pd.DataFrame(
            {
                "query_id": rows["query_id"][at].to_numpy(),
                "rank_no": np.arange(1, len(at) + 1),
                "chunk_id": rows["chunk_id"][at].to_numpy(),
                "first_rank": rows["rank_no"][at].to_numpy(),
                "relevance": relevance[at],
                "value": [v for _, v in chosen],
            }
        )

    schema = (
        f"query_id {kinds['query_id']}, rank_no bigint, chunk_id {kinds['chunk_id']}, first_rank bigint, "
        "relevance double, value double"
    )
    few = candidates.filter(F.col("rank_no") <= most).select("query_id", "question", "rank_no", "chunk_id", "content")
    return few.groupBy("query_id").applyInPandas(place, schema)
