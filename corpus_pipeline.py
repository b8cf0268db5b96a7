"""The corpus pipeline: quality, line dedup, near-dedup, passage dedup, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns
a DataFrame, all but the last with the columns of documents. run applies them to the
documents table, each to the written result of the one before. Every stage takes nulls in
any column, empty and very long texts, repeated rows, empty tables and further columns of
any name; what it does with them is said at its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ragassay.llm import minhash, nbsvm, packing, suffix, winnow
from ragassay.llm.common import durable
from ragassay.session import ship_package

#: the stages are hashes, a fitted model and a tokenizer: SQL has no words for them
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among docs, rejects go.

    A null text is scored as an empty one; repeated rows stay or go alike; without labels
    everything has score 0.5 and stays.
    """
    ship_package(spark)
    return nbsvm.keep_good(docs, nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three lines, and of lines of five words, are cut out.

    Null, empty and short texts stay as they are; rows that repeat doc_id and text are cut
    alike; a text of which nothing is left stays as an empty one.
    """
    return winnow.drop_lines(docs=_shipped(spark, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: 5-word shingles, similarity of 0.8.

    Null, empty and wordless texts are no duplicates and stay; rows that repeat a doc_id
    stay or go together. Five words are the general definition; op 10 takes four by its own.
    """
    return minhash.keep_one_of_each(_shipped(spark, docs))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages of 50 or more words are cut out.

    Null, empty and shorter texts stay as they are; rows that repeat doc_id and text are cut
    alike.
    """
    return suffix.cut_passages(_shipped(spark, docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096.

    Null and empty texts have one piece, the end; repeated rows are packed each on its own.
    """
    return packing.pack(_shipped(spark, docs), public_tokenizers.path("word_bpe_49k.json"))


def _shipped(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ship_package(spark)
    return docs


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
