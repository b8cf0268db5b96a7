"""Ranking metrics of a search: nDCG@k, recall@k and the mean reciprocal rank.

A chunk is relevant for a ground truth by the share of the truth's different tokens it
has: a quarter makes grade 1, a half grade 2, three quarters grade 3. The relevant chunks
of the whole corpus are looked for in the inverted index: a chunk with a quarter of n
tokens has one of the rarest n - n / 4 + 1, so that only postings of these propose chunks;
the common tokens are looked up for proposed chunks alone. Where that joins too many pairs,
the chunks are scanned and tasks hand on the relevant ones. The ideal order of a truth needs the number of its chunks of each grade, not the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragassay.functions.arrays import exploded
from ragassay.functions.text import token_set
from ragassay.operators import sparse
from ragassay.operators.sparse import Block, SparseIndex, _of_terms, _sent, lists_of, scan, sums
from ragassay.schemas import TOP_K
from ragassay.session import durable

GRADES = 3


def relevance(index: SparseIndex, truths: DataFrame) -> DataFrame:
    """truth_id, chunk_id, grade of all relevant chunks for truths (truth_id, ground_truth).

    A null or wordless truth has none. truth_id is unique.
    """
    rows = truths.select("truth_id", token_set(F.coalesce("ground_truth", F.lit(""))).alias("terms"))
    rows = rows.withColumn("n", F.size("terms"))
    words = exploded(rows, "terms", ["truth_id", "n"], "term")
    known = words.join(index.terms.select("term", "df"), "term")
    rarest = Window.partitionBy("truth_id").orderBy("df", "term")
    # tokens that no chunk has are rarer than these and propose nothing
    missing = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("truth_id"))
    needed = F.col("n") - F.ceil(F.col("n") / (GRADES + 1)) + 1 - missing
    asked = durable(
        known.select("truth_id", "term", "n", "df", (F.row_number().over(rarest) <= needed).alias("proposes"))
    )
    if (asked.agg(F.sum("df")).first()[0] or 0) > sparse.PAIRS:
        return _scanned(index, asked)
    asked = asked.drop("df")
    size = asked.count()
    first, others = asked.filter("proposes"), asked.filter("not proposes")
    found = _of_terms(index, first).join(_sent(first, size), "term").groupBy("truth_id", "chunk_id", "n").agg(
        F.count(F.lit(1)).alias("shared")
    )
    found = durable(found)
    wanted = durable(found.select("truth_id", "chunk_id", "n").join(others.select("truth_id", "term"), "truth_id"))
    more = _of_terms(index, others).join(_sent(wanted, wanted.count()), ["term", "chunk_id"])
    counted = found.unionByName(more.select("truth_id", "chunk_id", "n", F.lit(1).alias("shared"))).groupBy(
        "truth_id", "chunk_id", "n"
    ).agg(F.sum("shared").alias("shared"))
    grade = F.least(F.lit(GRADES), F.floor((GRADES + 1) * F.col("shared") / F.col("n"))).cast("bigint")
    return counted.select("truth_id", "chunk_id", grade.alias("grade")).filter("grade > 0")


def _graded(block: Block):
    """Kernel of a scan: the chunks that are relevant for each truth, by grade. A row's times
    are its truth's n."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            chunk = batch.column("chunk_id")
            begin, row, _, _ = lists_of(block, batch)
            ones = np.ones(len(row), np.int64)
            for no, mine, shared in sums(block, begin, row, ones, np.ones(len(block.no), np.int64), batch.num_rows):
                grade = np.minimum(GRADES, (GRADES + 1) * shared // block.times[mine[0]])
                if len(at := np.flatnonzero(grade)):
                    yield np.full(len(at), no), chunk.take(pa.array(at)), grade[at]

    return run


def _scanned(index: SparseIndex, asked: DataFrame) -> DataFrame:
    rows = asked.select(
        F.col("truth_id").alias("query_id"), "term", F.lit(0.0).alias("weight"), F.col("n").cast("bigint").alias("times")
    )
    return scan(index, rows, _graded, "grade").withColumnRenamed("query_id", "truth_id")


def _gain(grade: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1.0).cast("double")


def _discount(rank: Column) -> Column:
    return F.log2(rank + F.lit(1.0))


def _ideal(k: int) -> Column:
    """Discounted gain of the best order, from the numbers of chunks by grade (n_1 ... n_3)."""

    def at(rank: Column) -> Column:
        upto, grade = F.lit(0), F.lit(0)
        cases = []
        for g in range(GRADES, 0, -1):
            upto = upto + F.col(f"n_{g}")
            cases.append((upto, g))
        for total, g in reversed(cases):
            grade = F.when(rank <= total, F.lit(g)).otherwise(grade)
        return _gain(grade) / _discount(rank)

    parts = F.transform(F.sequence(F.lit(1), F.lit(k)), at)
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)


def query_metrics(ranked: DataFrame, relevant: DataFrame, asked: DataFrame, k: int = TOP_K) -> DataFrame:
    """ndcg, recall and reciprocal rank of each asked row (run_id, query_id, truth_id).

    ranked: query_id, rank_no, chunk_id, a chunk once for each query; relevant: as relevance
    makes it. ndcg and recall are null where the corpus has no relevant chunk; a query
    without results has zeroes.
    """
    best = ranked.filter(F.col("rank_no") <= k).select("query_id", "rank_no", "chunk_id")
    by_grade = [F.count_if(F.col("grade") == g).alias(f"n_{g}") for g in range(1, GRADES + 1)]
    totals = relevant.groupBy("truth_id").agg(*by_grade)
    hits = asked.join(best, "query_id").join(relevant, ["truth_id", "chunk_id"])
    met = hits.groupBy("run_id", "query_id", "truth_id").agg(
        F.array_sort(F.collect_list(F.struct("rank_no", "grade"))).alias("met")  # k at most
    )
    rows = asked.join(met, ["run_id", "query_id", "truth_id"], "left").join(totals, "truth_id", "left")
    gains = F.transform("met", lambda m: _gain(m["grade"]) / _discount(m["rank_no"]))
    found = F.aggregate(gains, F.lit(0.0), lambda total, part: total + part)
    relevant_ones = sum((F.col(f"n_{g}") for g in range(2, GRADES + 1)), F.col("n_1"))
    exists = F.col("n_1").isNotNull()
    return rows.select(
        "run_id",
        "query_id",
        "truth_id",
        F.when(exists, F.coalesce(found, F.lit(0.0)) / _ideal(k)).alias("ndcg"),
        F.when(exists, F.coalesce(F.size("met"), F.lit(0)) / relevant_ones).alias("recall"),
        F.coalesce(F.lit(1.0) / F.col("met")[0]["rank_no"], F.lit(0.0)).alias("reciprocal_rank"),
    )


def run_metrics(scored: DataFrame) -> DataFrame:
    """Means per run: n_pairs (of query and ground truth), n_judged (with relevant chunks),
    ndcg, recall, mrr."""
    return scored.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count("ndcg").alias("n_judged"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("recall").alias("recall"),
        F.avg("reciprocal_rank").alias("mrr"),
    )
