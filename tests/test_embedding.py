"""Batching, order and retry of the embedding stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragassay.functions.embedding import call_with_retry, embed_texts, hashing_embedder


def test_batches_keep_order(spark):
    def lengths(texts, task):
        assert len(texts) <= 2 and task == "document"
        return np.array([[len(t), len(texts)] for t in texts], dtype=float)

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 4)], "id int, t string").coalesce(1)
    rows = df.select("id", embed_texts(lengths, batch_size=2)("t").alias("v")).orderBy("id").collect()
    assert [r.v for r in rows] == [[1.0, 2.0], [2.0, 2.0], [3.0, 1.0]]


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, t string").coalesce(1)
    rows = df.select("id", embed_texts(hashing_embedder(8))("t").alias("v")).orderBy("id").collect()
    assert rows[1].v is None
    assert rows[2].v == [0.0] * 8
    assert np.isclose(np.linalg.norm(rows[0].v), 1.0)


def test_first_failure_is_retried():
    calls = []

    def flaky(texts, task):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("busy")
        return np.ones((len(texts), 2))

    assert call_with_retry(flaky, ["a"], "document", wait_seconds=(0, 0)).shape == (1, 2)
    assert len(calls) == 2


def test_lasting_failure_raises():
    def broken(texts, task):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        call_with_retry(broken, ["a"], "document", attempts=5, wait_seconds=(0, 0))


def test_hashing_embedder_is_deterministic_and_case_blind():
    embed = hashing_embedder(64)
    a, b = embed(["Net interest income", "net INTEREST income"], "document")
    assert np.array_equal(a, b)


def test_query_task_reaches_the_model(spark):
    def by_task(texts, task):
        return np.full((len(texts), 1), 1.0 if task == "query" else 0.0)

    df = spark.createDataFrame([("a",)], "t string")
    assert df.select(embed_texts(by_task, task="query")(F.col("t"))).first()[0] == [1.0]
