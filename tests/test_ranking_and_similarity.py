"""Semantic similarity judge and ranking metrics against plain loops."""

import math
import random
import re

import numpy as np
import pytest

from ragassay.functions.embedding import hashing_embedder
from ragassay.operators import evaluate, ranking, sparse

WORD = re.compile(r"[^\W_]+")
FETCHED = "run_id int, query_id int, question string, generated_answer string, ground_truth string"


def fetched(spark):
    texts = ["red green blue", "Red, green!", "something else entirely", "", "boom red", "x"]
    rows = [(1, 10 * i + k, "q", a, t) for i, a in enumerate(texts) for k, t in enumerate([*texts, None])]
    return spark.createDataFrame(rows, FETCHED), rows


def cosine(a, b, embed):
    one, two = embed([a, b], "").astype(float)
    scale = np.linalg.norm(one) * np.linalg.norm(two)
    return float(one @ two / scale) if scale else 0.0


def test_similarity_scores(spark):
    docs, rows = fetched(spark)
    embed = hashing_embedder(64)
    got = {r.query_id: r.scores for r in evaluate.judge_similarity(docs, embed).collect()}
    assert set(got) == {r[1] for r in rows if r[4] is not None}
    for _, query, _, answer, truth in rows:
        if truth is not None:
            (score,) = got[query]
            want = cosine(answer, truth, embed)
            assert score.metric_name == "semantic_similarity"
            assert score.score == pytest.approx(round(5 * max(0.0, want), 4), abs=1.1e-4)
            assert abs(float(score.reasoning.rsplit(" ", 1)[1]) - want) < 6e-5


def test_a_failing_model_costs_one_row_its_score(spark):
    docs, rows = fetched(spark)
    inner = hashing_embedder(16)

    def embed(texts, task):
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        return inner(texts, task) * 7  # any length

    judged = evaluate.with_similarity(evaluate.default_judges(docs), embed).collect()
    by_query = {r.query_id: [s.metric_name for s in r.scores] for r in judged}
    for _, query, _, answer, truth in rows:
        plain = ["correctness"] if truth is not None else ["context_relevance", "faithfulness", "answer_relevance"]
        scored = truth is not None and "boom" not in answer + truth
        assert by_query[query] == plain + ["semantic_similarity"] * scored
    again = {r.query_id: r.scores for r in evaluate.judge_similarity(docs, embed).collect()}
    assert again[11][0].score == pytest.approx(5 * max(0, cosine("Red, green!", "Red, green!", inner)), abs=1e-3)


def grades(chunks, truths):
    held = {i: set(WORD.findall((t or "").lower())) for i, t in chunks}
    out = {}
    for j, t in truths:
        words = set(WORD.findall((t or "").lower()))
        for i, have in held.items():
            if words and (grade := min(3, 4 * len(words & have) // len(words))):
                out[j, i] = grade
    return out


def corpus():
    r = random.Random(8)
    words = ["the", "of"] * 30 + [f"w{i}" for i in range(50)]
    chunks = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 20, 60])))) for i in range(150)] + [(150, None)]
    truths = [(j, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 7, 25])))) for j in range(40)]
    truths += [(40, None), (41, "..."), (42, "nobody says this"), (43, chunks[5][1] or "w1"), (44, "nobody w1")]
    return chunks, truths


def test_relevant_chunks(spark):
    chunks, truths = corpus()
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string"))
    got = ranking.relevance(index, spark.createDataFrame(truths, "truth_id bigint, ground_truth string"))
    assert {(r.truth_id, r.chunk_id): r.grade for r in got.collect()} == grades(chunks, truths)


def test_many_relevant_chunks_are_found_in_a_scan(spark, monkeypatch):
    chunks, truths = corpus()
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string").repartition(3))
    asked = spark.createDataFrame(truths, "truth_id bigint, ground_truth string")
    monkeypatch.setattr(sparse, "PAIRS", 0)
    for rows in (sparse.BLOCK_ROWS, 30):
        monkeypatch.setattr(sparse, "BLOCK_ROWS", rows)
        got = ranking.relevance(index, asked).collect()
        assert len(got) == len(grades(chunks, truths))
        assert {(r.truth_id, r.chunk_id): r.grade for r in got} == grades(chunks, truths)
    assert not sparse._exists(spark, f"{index.folder}/postings")


def test_metrics_of_runs(spark):
    chunks, truths = corpus()
    relevant, k, r = grades(chunks, truths), 5, random.Random(4)
    ranked, asked = [], []
    for q in range(60):
        asked += [(q % 3, q, j) for j in r.sample(range(45), r.choice([1, 1, 2]))]
        found = r.sample(range(151), r.choice([0, 1, 4, 8]))
        ranked += [(q, n, i) for n, i in enumerate(found, 1)]
    rows = [(j, i, g) for (j, i), g in relevant.items()]
    scored = ranking.query_metrics(
        spark.createDataFrame(ranked, "query_id int, rank_no int, chunk_id bigint"),
        spark.createDataFrame(rows, "truth_id bigint, chunk_id bigint, grade bigint"),
        spark.createDataFrame(asked, "run_id int, query_id int, truth_id bigint"),
        k,
    )
    want = {}
    for run, q, j in asked:
        mine = [(n, relevant[j, i]) for p, n, i in ranked if p == q and n <= k and (j, i) in relevant]
        every = sorted((g for (t, _), g in relevant.items() if t == j), reverse=True)
        gain = lambda pairs: sum((2**g - 1) / math.log2(n + 1) for n, g in pairs)
        ndcg = gain(mine) / gain(enumerate(every[:k], 1)) if every else None
        want[run, q, j] = (ndcg, len(mine) / len(every) if every else None, 1 / mine[0][0] if mine else 0.0)
    got = {(x.run_id, x.query_id, x.truth_id): x for x in scored.collect()}
    assert set(got) == set(want)
    for key, (ndcg, recall, reciprocal) in want.items():
        x = got[key]
        assert (x.ndcg is None) == (ndcg is None) and (x.recall is None) == (recall is None)
        assert x.ndcg == pytest.approx(ndcg) and x.recall == pytest.approx(recall)
        assert x.reciprocal_rank == pytest.approx(reciprocal)
    for row in ranking.run_metrics(scored).collect():
        mine = [v for (run, _, _), v in want.items() if run == row.run_id]
        judged = [v for v in mine if v[0] is not None]
        assert (row.n_pairs, row.n_judged) == (len(mine), len(judged))
        assert row.ndcg == pytest.approx(sum(v[0] for v in judged) / len(judged))
        assert row.mrr == pytest.approx(sum(v[2] for v in mine) / len(mine))
