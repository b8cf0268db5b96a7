"""Approximate vector search against scoring every vector."""

import re

import numpy as np
import pytest

from ragassay.operators import vector_index as vi

KINDS = "chunk_id bigint, doc_id bigint, embedding array<float>"


def clustered(n=6000, d=20, k=60, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(k, d))
    vectors = centres[r.integers(0, k, n)] + 0.35 * r.normal(size=(n, d))
    vectors[: n // 3] = vectors[0]  # a third of all vectors are copies
    return vectors.astype(np.float32)


def frame(spark, vectors, more=()):
    rows = [(i, i // 2, v.tolist()) for i, v in enumerate(vectors)] + list(more)
    return spark.createDataFrame(rows, KINDS).repartition(6)


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def searched(spark):
    vectors = clustered()
    odd = [(90_000, 1, None), (90_001, 1, [0.0] * vectors.shape[1])]
    index = vi.build_index(frame(spark, vectors, odd), list_size=100)
    return vectors, index


def ask(spark, vectors, at):
    rows = [(int(i), vectors[i].tolist()) for i in at] + [(-1, None), (-2, [0.0] * vectors.shape[1])]
    return spark.createDataFrame(rows, "query_id bigint, embedding array<float>")


def test_recall_and_exact_scores(spark, searched):
    vectors, index = searched
    at = np.arange(2500, 6000, 50)
    got = vi.approximate_search(index, ask(spark, vectors, at), 5, -1.0).collect()
    all_scores = unit(vectors.astype(float)) @ unit(vectors.astype(float)).T
    met, wanted = 0, 0
    for q in at.tolist():
        mine = sorted((r.rank_no, r.chunk_id, r.similarity_score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and mine[0][1] == q
        for _, chunk, score in mine:
            assert score == pytest.approx(all_scores[q, chunk], abs=1e-9)
        assert mine == sorted(mine, key=lambda m: (-round(m[2], 12), m[1]))
        best = np.argsort(-all_scores[q], kind="stable")[:5]
        met += len({m[1] for m in mine} & set(best.tolist()))
        wanted += 5
    assert met / wanted >= 0.9
    assert {r.query_id for r in got} == set(at.tolist())


def test_few_lists_are_read(spark, searched):
    vectors, index = searched
    assert len(index.quantiser.centres) >= 50 and index.n_probes <= len(index.quantiser.centres) // 3
    ids = vi.pa.array([2500])
    plan = vi._candidates(index, ids, unit(vectors[2500:2501].astype(float)), 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*list[^]]* IN ", plan)
    assert "embedding" not in re.search(r"ReadSchema: \S+", plan).group()


def test_copies_and_threshold(spark, searched):
    vectors, index = searched
    got = vi.approximate_search(index, ask(spark, vectors, [0]), 5, 0.999, refine=1).collect()
    # of equal vectors the codes tie: any of the copies, in order of their ids
    assert len(got) == 5 and all(r.chunk_id < 2000 and r.similarity_score > 0.999 for r in got)
    assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank_no)] == sorted(r.chunk_id for r in got)
    assert vi.approximate_search(index, ask(spark, vectors, [0]).filter("query_id < 0"), 5, -1.0).collect() == []


def test_blocks_of_questions_change_nothing(spark, searched, monkeypatch):
    vectors, index = searched
    asked = ask(spark, vectors, range(3000, 3040))
    want = sorted(map(tuple, vi.approximate_search(index, asked, 3, 0.2).collect()))
    monkeypatch.setattr(vi, "BLOCK", 15)
    monkeypatch.setattr(vi, "SENT_ROWS", 0)
    assert sorted(map(tuple, vi.approximate_search(index, asked, 3, 0.2).collect())) == want


def test_recall_counts_equal_vectors(spark):
    exact = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 7, 0.4)], "query_id int, chunk_id int, similarity_score double")
    found = spark.createDataFrame([(1, 1, 0.9), (1, 3, 0.5)], "query_id int, chunk_id int, similarity_score double")
    assert sorted(map(tuple, vi.recall(found, exact).collect())) == [(1, 2, 1.0), (2, 1, 0.0)]


def test_few_and_no_vectors(spark):
    for rows in ([], [(1, 1, [1.0, 0.0])], [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0])]):
        index = vi.build_index(spark.createDataFrame(rows, KINDS))
        asked = spark.createDataFrame([(5, [1.0, 0.1])], "query_id bigint, embedding array<float>")
        got = vi.approximate_search(index, asked, 5, -1.0).collect()
        assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank_no)] == [r[0] for r in rows]
