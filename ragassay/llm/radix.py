"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are split by successive bytes of their normalised text. A digit is a run
of bytes that grows from round to round; documents that agree so far stay in one
group, groups of one document and groups whose text has ended leave. Groups are
told apart by the bytes themselves, no digest takes part. A round costs a count per
group, combined in every task before the shuffle, and a join of that count to its
rows, in which Spark can split a group that holds a large part of all rows. What
is left of the texts goes to a durable table after each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import durable, lower_ascii, sorted_join, texts_of

#: bytes of the first digit; each later digit is so many times longer
FIRST, GROWTH = 64, 16


def _split(rows: DataFrame, width: int) -> DataFrame:
    """Split each group by its next digit.

    rows: row_id, doc_id, digest, part (group so far), rest (bytes to come).
    """
    # the length stands beside the digit: a text that ends is no prefix of another
    dealt = rows.select(
        "row_id",
        "doc_id",
        "digest",
        "part",
        F.substring("rest", 1, width).alias("digit"),
        F.least(F.octet_length("rest"), F.lit(width + 1)).alias("left"),
        "rest",
    )
    keys = ["part", "digit", "left"]
    # written first: both sides of the join are then dealt by its keys alone, and Spark
    # splits the rows of a group that is too large for one task
    counts = durable(
        dealt.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max("row_id").alias("__part"),
            F.max(F.struct("doc_id", "row_id")).alias("best"),
        )
    )
    split = sorted_join(dealt, counts, keys)
    goes_on = (F.col("group_size") > 1) & (F.col("left") > width)
    return split.select(
        "row_id",
        "doc_id",
        "digest",
        F.col("__part").alias("part"),
        F.when(goes_on, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        "group_size",
        "best",
        goes_on.alias("goes_on"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    One row for each row of docs: doc_id, keep_id (largest doc_id of the group),
    group_size, kept, text_sha256 (of the normalised text). A null text is empty;
    empty texts form one group. Of repeated rows with the largest doc_id exactly
    one is kept; a null doc_id is smaller than any other. An empty table gives an
    empty result; further columns are not read. Very long texts take more rounds,
    each of which reads only the groups that are still open.
    """
    text = texts_of(docs).select(
        "doc_id", lower_ascii("text").cast("binary").alias("rest")
    ).withColumns(
        {
            "digest": F.unhex(F.sha2("rest", 256)),
            "digit": F.substring("rest", 1, FIRST),
            "left": F.least(F.octet_length("rest"), F.lit(FIRST + 1)),
        }
    )
    sizes = text.groupBy("digit", "left").agg(F.count(F.lit(1)).alias("n"))
    several = F.coalesce(F.col("n"), F.lit(1))
    first = durable(
        sorted_join(text, durable(sizes.filter("n > 1")), ["digit", "left"], "left").select(
            # written with the rows: reads of one table need not be split alike
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            "digest",
            several.alias("group_size"),
            F.when(several > 1, F.col("rest")).alias("rest"),
        )
    )
    alone = F.col("group_size") == 1
    done = [
        first.filter(alone).select(
            "row_id", "doc_id", "digest", "group_size", F.struct("doc_id", "row_id").alias("best")
        )
    ]
    rows = first.filter(~alone).withColumn("part", F.lit(-1).cast("bigint"))
    width = FIRST
    while not rows.isEmpty():
        width *= GROWTH
        split = durable(_split(rows, width))
        done.append(split.filter("not goes_on").select(done[0].columns))
        rows = split.filter("goes_on").select("row_id", "doc_id", "digest", "part", "rest")
    result = reduce(DataFrame.union, done)
    return result.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
