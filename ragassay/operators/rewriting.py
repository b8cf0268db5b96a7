"""Rewritten questions: expansion by what a first search finds, and decomposition into parts.

Both work on the inverted index. An expansion adds to each question the terms that weigh
most in its first results; a decomposition searches the sentences of a question each on
its own and merges their results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragassay.functions.arrays import exploded
from ragassay.operators.hybrid import RANK_OFFSET
from ragassay.operators.sparse import UNIT, SparseIndex, _sent, asked_terms, counted, search_terms, sparse_search, weighted
from ragassay.schemas import TOP_K
from ragassay.session import durable

#: chunks of the first search that are taken as relevant, terms that they add
FEEDBACK, ADDED = 10, 5
#: a term of the question counts as often as so many added ones
OWN_WEIGHT = 4
#: part of a reciprocal rank that is counted in whole numbers
SHARES = 1_000_000_000


def expansion_terms(
    index: SparseIndex, questions: DataFrame, feedback: int = FEEDBACK, added: int = ADDED
) -> DataFrame:
    """query_id, term, gain: the terms that a first search adds to each question.

    A term's gain is its share of each found chunk times its weight, summed over the chunks;
    terms of the question itself are none. Equal gains go by term.
    """
    own = asked_terms(index, questions).select("query_id", "term")
    first = durable(sparse_search(index, questions, feedback).select("query_id", "chunk_id"))
    # the found chunks are few: they are picked out of a scan, then have their terms listed
    wanted = _sent(first.select("chunk_id").distinct(), first.count())
    found = counted(index.chunks.join(wanted, "chunk_id", "left_semi")).join(first, "chunk_id")
    known = found.join(index.terms.withColumn("weight", index.weight()).select("term", "weight"), "term")
    gain = F.floor(F.col("weight") * (F.col("tf") / F.col("length")) * UNIT)
    gains = known.groupBy("query_id", "term").agg(F.sum(gain).alias("gain"))
    new = gains.join(own, ["query_id", "term"], "left_anti")
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "term")
    ranked = new.withColumn("no", F.row_number().over(best)).filter(F.col("no") <= added)
    return ranked.select("query_id", "term", "gain")


def expanded_search(
    index: SparseIndex,
    questions: DataFrame,
    top_k: int = TOP_K,
    feedback: int = FEEDBACK,
    added: int = ADDED,
) -> DataFrame:
    """Search with the terms of the question and those of its first results: query_id,
    rank_no, chunk_id, score (in the same unit as that of a plain search)."""
    more = expansion_terms(index, questions, feedback, added).select("query_id", "term", F.lit(1).alias("times"))
    own = asked_terms(index, questions).select("query_id", "term", (F.col("times") * OWN_WEIGHT).alias("times"))
    found = search_terms(index, weighted(index, own.unionByName(more)), top_k)
    return found.withColumn("score", F.col("score") / F.lit(float(OWN_WEIGHT)))


def parts_of(questions: DataFrame) -> DataFrame:
    """query_id, part, question: the sentences and clauses of each question that hold a word."""
    rows = questions.select("query_id", F.split(F.coalesce("question", F.lit("")), r"[.?!;\n]+").alias("parts"))
    parts = exploded(rows, "parts", ["query_id"], "question", "part")
    return parts.filter(F.col("question").rlike(r"[\p{L}\p{N}]"))


def decomposed_search(
    index: SparseIndex, questions: DataFrame, top_k: int = TOP_K, per_part: int = 2 * TOP_K
) -> DataFrame:
    """Search the parts of each question and merge: query_id, rank_no, chunk_id, n_parts.

    A chunk has the sum of its reciprocal ranks over the parts (in whole numbers, so that
    ties are exact); n_parts counts the parts that found it. Equal sums go by chunk_id.
    """
    parts = parts_of(questions).withColumn("asked", F.col("query_id"))
    key = F.struct("asked", "part")
    found = sparse_search(index, parts.select(key.alias("query_id"), "question"), per_part)
    share = F.floor(F.lit(SHARES) / (F.col("rank_no") + RANK_OFFSET))
    merged = found.groupBy(F.col("query_id.asked").alias("query_id"), "chunk_id").agg(
        F.sum(share).alias("share"), F.count(F.lit(1)).alias("n_parts")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("share"), "chunk_id")
    ranked = merged.withColumn("rank_no", F.row_number().over(best).cast("bigint"))
    return ranked.filter(F.col("rank_no") <= top_k).select("query_id", "rank_no", "chunk_id", "n_parts")
