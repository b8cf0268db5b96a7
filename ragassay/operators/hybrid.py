"""Hybrid retrieval: fusion of ranked lists of different searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragassay.schemas import TOP_K

#: ranks are counted from here on, so that the first places do not outweigh everything
RANK_OFFSET = 60
#: weight of the sparse and of the dense list
WEIGHTS = (1.0, 1.0)


def fused(
    sparse: DataFrame,
    dense: DataFrame,
    top_k: int = TOP_K,
    weights: tuple[float, float] = WEIGHTS,
    offset: int = RANK_OFFSET,
) -> DataFrame:
    """Top-k chunks of two ranked lists (query_id, rank_no, chunk_id) by reciprocal ranks.

    query_id, rank_no, chunk_id, fused_score, sparse_rank, dense_rank. A chunk that one list
    has not got adds nothing for it, so lists may differ in length, and a question may be in
    one of them only. Equal scores rank by chunk_id. Both lists have at most their k rows
    for each question, which the join and the window hold.
    """
    keys = ["query_id", "chunk_id"]
    left = sparse.select(*keys, F.col("rank_no").cast("bigint").alias("sparse_rank"))
    right = dense.select(*keys, F.col("rank_no").cast("bigint").alias("dense_rank"))
    both = left.join(right, keys, "full")

    def share(name: str, weight: float) -> Column:
        return F.coalesce(F.lit(weight) / (F.col(name) + F.lit(float(offset))), F.lit(0.0))

    scored = both.withColumn(
        "fused_score", share("sparse_rank", weights[0]) + share("dense_rank", weights[1])
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "chunk_id")
    ranked = scored.withColumn("rank_no", F.row_number().over(order).cast("bigint"))
    return ranked.filter(F.col("rank_no") <= top_k).select(
        "query_id", "rank_no", "chunk_id", "fused_score", "sparse_rank", "dense_rank"
    )
