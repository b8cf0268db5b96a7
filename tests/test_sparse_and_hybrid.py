"""Inverted index, BM25 top-k by bounds, and rank fusion, against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ragassay.operators import hybrid, sparse
from ragassay.sources import fixtures as fx

WORDS = re.compile(r"[^\W_]+")


def rows_of(seed=3, n=300):
    r = random.Random(seed)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(400)]
    chunks = []
    for i in range(n):
        size = r.choice([0, 1, 5, 40, 160])
        words = [r.choice(common) if r.random() < 0.5 else rare[int(r.paretovariate(0.6)) % 400] for _ in range(size)]
        chunks.append((i, " ".join(words)))
    chunks += [(n, None), (n + 1, ""), (n + 2, chunks[3][1]), (n + 3, chunks[3][1]), (n + 4, "  \n")]
    questions = [(q, " ".join(r.choice(common + rare[:60]) for _ in range(r.choice([1, 3, 9, 30])))) for q in range(40)]
    questions += [(100, None), (101, ""), (102, "unseen words only"), (103, "the the THE w1"), (104, chunks[3][1])]
    return chunks, questions


def all_scores(chunks, questions):
    split = {i: WORDS.findall((t or "").lower()) for i, t in chunks}
    mean = sum(map(len, split.values())) / len(split)
    postings = defaultdict(dict)
    for i, words in split.items():
        for w, tf in Counter(words).items():
            postings[w][i] = tf
    for q, text in questions:
        scores = Counter()
        for w, times in Counter(WORDS.findall((text or "").lower())).items():
            df = len(postings[w])
            weight = math.log(1.0 + (len(split) - df + 0.5) / (df + 0.5))
            for i, tf in postings[w].items():
                part = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(split[i]) / mean)))
                scores[i] += times * math.floor(weight * part * 1_000_000)
        yield q, scores


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search_equals_scoring_everything(spark, k):
    chunks, questions = rows_of()
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string").repartition(5), buckets=8)
    assert index.n_chunks == len(chunks)
    got = sparse.sparse_search(index, spark.createDataFrame(questions, "query_id bigint, question string"), k).collect()
    want = []
    for q, scores in all_scores(chunks, questions):
        best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
        want += [(q, rank, i, round(s / 1e6, 6)) for rank, (i, s) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank_no, r.chunk_id, round(r.score, 6)) for r in got) == sorted(want)


def test_limits_on_what_is_sent_change_nothing(spark, monkeypatch):
    chunks, questions = rows_of(5, 120)
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string"))
    asked = spark.createDataFrame(questions, "query_id bigint, question string")
    want = sorted(map(tuple, sparse.sparse_search(index, asked).collect()))
    monkeypatch.setattr(sparse, "SENT_ROWS", 0)
    monkeypatch.setattr(sparse, "TERM_LIST", 2)
    assert sorted(map(tuple, sparse.sparse_search(index, asked).collect())) == want


def test_common_terms_are_scored_for_few_chunks(spark, monkeypatch):
    """The long lists are not summed over all their chunks."""
    chunks = [(i, f"the of and w{i % 50}") for i in range(2000)]
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string"))
    asked = spark.createDataFrame([(1, "the w7"), (2, "the and w9")], "query_id bigint, question string")
    seen = []
    summed = sparse._scored

    def counted(index, terms, n):
        out = summed(index, terms, n)
        seen.append(out.count())
        return out

    monkeypatch.setattr(sparse, "SEEDS", 1)
    monkeypatch.setattr(sparse, "_scored", counted)
    got = sparse.sparse_search(index, asked, 5).collect()
    assert max(seen) <= 80  # of 4,000 pairs of question and chunk
    assert {r.chunk_id % 50 for r in got if r.query_id == 1} == {7}


def test_the_plan_reads_few_folders_and_no_texts(spark, folder):
    chunks, _ = rows_of()
    sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string"), folder + "/index", 16)
    index = sparse.open_index(spark, folder + "/index")
    asked = sparse.asked_terms(index, spark.createDataFrame([(1, "the w1")], "query_id bigint, question string"))
    plan = sparse._of_terms(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket[^]]* IN ", plan)
    assert re.search(r"PushedFilters: \[[^]]*In\(term, ", plan)
    assert "content" not in plan


@pytest.mark.parametrize("k", [1, 5, 50])
def test_a_scan_of_the_chunks_equals_scoring_everything(spark, monkeypatch, k):
    """Batches with many pairs of question and posting are scored where the chunks lie."""
    chunks, questions = rows_of()
    # equal scores in all tasks, and a term that every chunk has
    chunks = [(i, f"{t or ''} all") for i, t in chunks] + [(1000 + i, "all") for i in range(200)]
    questions += [(105, "all"), (106, "all w1")]
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string").repartition(5))
    monkeypatch.setattr(sparse, "PAIRS", 0)
    monkeypatch.setattr(sparse, "_looked_up", None)
    asked = spark.createDataFrame(questions, "query_id bigint, question string")
    want = []
    for q, scores in all_scores(chunks, questions):
        best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
        want += [(q, rank, i, round(s / 1e6, 6)) for rank, (i, s) in enumerate(best, 1)]
    for rows in (sparse.BLOCK_ROWS, 40):  # one block of questions, many
        monkeypatch.setattr(sparse, "BLOCK_ROWS", rows)
        got = sparse.sparse_search(index, asked, k).collect()
        assert sorted((r.query_id, r.rank_no, r.chunk_id, round(r.score, 6)) for r in got) == sorted(want)


def test_a_scan_takes_other_keys(spark, monkeypatch):
    rows = [(f"é{i}", "all") for i in range(30)] + [("z", "all w w")]
    index = sparse.build_index(spark.createDataFrame(rows, "chunk_id string, content string").repartition(3))
    asked = spark.createDataFrame([((1, 2), "all"), ((1, 3), "w")], "query_id struct<a:int, b:int>, question string")
    monkeypatch.setattr(sparse, "PAIRS", 0)
    got = sorted((tuple(r.query_id), r.rank_no, r.chunk_id) for r in sparse.sparse_search(index, asked, 3).collect())
    assert got == [((1, 2), 1, "é0"), ((1, 2), 2, "é1"), ((1, 2), 3, "é10"), ((1, 3), 1, "z")]


def test_terms_of_no_weight_find_chunks_in_a_scan():
    block = sparse.Block(pa.array(["all", "w"]), np.array([1e-9, 2.0]), *map(np.array, ([7, 7, 8], [0, 1, 1], [1, 1, 2])))
    batches = [
        pa.record_batch({"chunk_id": ids, "length": [len(t) for t in held], "terms": held, "tfs": [[1] * len(t) for t in held]})
        for ids, held in ((["c", "b"], [["all"], ["all"]]), (["d", "a"], [["all", "w"], ["x"]]), (["B"], [["all"]]))
    ]
    ((no, chunk, score),) = sparse._keep_best(block, 3, 1.0)(iter(batches))
    assert list(zip(no.tolist(), chunk.to_pylist(), (score > 0).tolist())) == [
        (7, "d", True), (7, "B", False), (7, "b", False), (8, "d", True)
    ]


def test_a_batch_joins_no_postings(spark, monkeypatch):
    """What tasks hand on is k rows of each question, not a row of each pair."""
    chunks = [(i, f"the of and w{i % 50}") for i in range(2000)]
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string").repartition(4))
    asked = spark.createDataFrame([(1, "the w7"), (2, "the and w9")], "query_id bigint, question string")
    monkeypatch.setattr(sparse, "PAIRS", 0)
    assert sparse._scanned(index, sparse.asked_terms(index, asked), 5).count() <= 4 * 2 * 5
    assert not sparse._exists(spark, f"{index.folder}/postings")


def test_an_empty_index(spark):
    index = sparse.build_index(spark.createDataFrame([], "chunk_id string, content string"))
    asked = spark.createDataFrame([(1, "some words")], "query_id bigint, question string")
    assert index.n_chunks == 0 and sparse.sparse_search(index, asked).collect() == []


def test_texts_of_the_fused_search_are_not_sorted(spark, sf):
    """Their sort would grow with the texts in a task; ids are held, texts pass by."""
    live = fx.documents(spark, sf).select("doc_id")
    chunks = fx.document_chunks(spark, sf, embedded=False)
    met = chunks.join(live.hint("shuffle_hash"), "doc_id", "left_semi")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "embedding" not in chunks.columns
    want = fx.document_chunks(spark, sf).drop("embedding").collect()
    assert sorted(map(tuple, chunks.collect())) == sorted(map(tuple, want))


def test_fusion(spark):
    r = random.Random(2)
    lists = []
    for size in (20, 7):
        rows = []
        for q in range(30):
            found = r.sample(range(60), r.randint(0, size))
            rows += [(q, rank, i) for rank, i in enumerate(found, 1)]
        lists.append(rows)
    frames = [spark.createDataFrame(rows, "query_id bigint, rank_no int, chunk_id bigint") for rows in lists]
    for weights in ((1.0, 1.0), (0.3, 2.0)):
        scores = defaultdict(lambda: [None, None])
        for n, rows in enumerate(lists):
            for q, rank, i in rows:
                scores[q, i][n] = rank
        want = []
        for q in range(30):
            found = []
            for (p, i), ranks in scores.items():
                if p == q:
                    score = sum(w / (rank + 60) if rank else 0.0 for w, rank in zip(weights, ranks))
                    found.append((-score, i, *ranks))
            found.sort(key=lambda f: f[:2])
            want += [(q, n, i, round(-s, 12), a, b) for n, (s, i, a, b) in enumerate(found[:5], 1)]
        got = hybrid.fused(*frames, top_k=5, weights=weights).collect()
        assert sorted(((*x[:3], round(x[3], 12), *x[4:]) for x in map(tuple, got)), key=repr) == sorted(want, key=repr)
