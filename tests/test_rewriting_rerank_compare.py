"""Expansion, decomposition, reranking and comparison of runs against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ragassay.operators import compare, rerank, rewriting, sparse
from test_sparse_and_hybrid import WORDS, all_scores, rows_of


@pytest.fixture(scope="module")
def indexed(spark):
    chunks, questions = rows_of(11, 150)
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id bigint, content string"), buckets=4)
    return chunks, questions[:15] + questions[-5:], index


def best(scores, k):
    return sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]


def test_expansion(spark, indexed):
    chunks, questions, index = indexed
    split = {i: WORDS.findall((t or "").lower()) for i, t in chunks}
    n = len(split)
    df = Counter(w for words in split.values() for w in set(words))
    weight = {w: math.log(1.0 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    mean = sum(map(len, split.values())) / n
    want = {}
    for q, scores in all_scores(chunks, questions):
        text = dict(questions)[q]
        own = Counter(WORDS.findall((text or "").lower()))
        gains = Counter()
        for i, _ in best(scores, 10):
            for w, tf in Counter(split[i]).items():
                gains[w] += math.floor(weight[w] * (tf / len(split[i])) * 1_000_000)
        added = [w for w, _ in sorted(((w, g) for w, g in gains.items() if w not in own), key=lambda g: (-g[1], g[0]))[:5]]
        times = Counter({w: 4 * c for w, c in own.items() if w in df}) + Counter(added)
        total = Counter()
        for w, c in times.items():
            for i, words in split.items():
                if tf := words.count(w):
                    part = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(words) / mean)))
                    total[i] += c * math.floor(weight[w] * part * 1_000_000)
        for rank, (i, s) in enumerate(best(total, 5), 1):
            want[q, rank] = (i, s / 4e6)
    got = rewriting.expanded_search(index, spark.createDataFrame(questions, "query_id bigint, question string"), 5)
    assert {(r.query_id, r.rank_no): (r.chunk_id, pytest.approx(r.score)) for r in got.collect()} == want


def test_decomposition(spark, indexed):
    chunks, questions, index = indexed
    joined = [(q, f"{t or ''}. {u or ''}?\n!;{t or ''}") for (q, t), (_, u) in zip(questions, questions[1:])] + [(900, None), (901, "?!.")]
    want = {}
    for q, text in joined:
        parts = [p for p in re.split(r"[.?!;\n]+", text or "") if WORDS.search(p)]
        shares, counts = Counter(), Counter()
        for _, scores in all_scores(chunks, list(enumerate(parts))):
            for rank, (i, _) in enumerate(best(scores, 10), 1):
                shares[i] += 1_000_000_000 // (rank + 60)
                counts[i] += 1
        for rank, (i, _) in enumerate(best(shares, 5), 1):
            want[q, rank] = (i, counts[i])
    got = rewriting.decomposed_search(index, spark.createDataFrame(joined, "query_id bigint, question string"), 5)
    assert {(r.query_id, r.rank_no): (r.chunk_id, r.n_parts) for r in got.collect()} == want


def tokens(text):
    out = []
    for w in WORDS.findall((text or "").lower()):
        v = np.zeros(64)
        for a in range(len(w)):
            code = int.from_bytes(hashlib.md5(f"<{w}>"[a : a + 3].encode()).digest()[:4], "big")
            v[code % 64] += 1 if code < 2**31 else -1
        out.append(v / (np.linalg.norm(v) or 1))
    return out


def test_reranking(spark):
    r = random.Random(6)
    words = ["grow", "growth", "growing", "rate", "rates", "sea", "seas", "coal"]
    rows = []
    for q in range(12):
        asked = " ".join(r.choice(words) for _ in range(3)) if q else None
        for rank in range(1, r.randint(2, 9)):
            text = r.choice([None, "", "...", *[" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(5)]])
            rows.append((q, asked, rank, 100 * q + rank, text))
    rows += [(50, "grow", 60, 1, "grow"), (50, "grow", 2, 2, "sea")]
    got = defaultdict(list)
    frame = spark.createDataFrame(rows, "query_id bigint, question string, rank_no bigint, chunk_id bigint, content string")
    for x in rerank.reranked(frame, 4, 0.6).collect():
        got[x.query_id].append((x.rank_no, x.chunk_id, x.first_rank, round(x.relevance, 9), round(x.value, 9)))
    for q in {row[0] for row in rows}:
        mine = sorted(row[2:] for row in rows if row[0] == q and row[2] <= 50)
        asked = tokens(next(row[1] for row in rows if row[0] == q))
        found = [tokens(t) for _, _, t in mine]
        relevance = [float(np.mean([max(a @ b for b in f) for a in asked])) if asked and f else 0.0 for f in found]
        means = [np.mean(f, axis=0) if f else np.zeros(64) for f in found]
        means = [m / (np.linalg.norm(m) or 1) for m in means]
        chosen, want = [], []
        while len(chosen) < min(4, len(mine)):
            value = lambda i: round(0.6 * relevance[i] - 0.4 * max((means[i] @ means[j] for j in chosen), default=0.0), 12)
            at = max((i for i in range(len(mine)) if i not in chosen), key=lambda i: (value(i), -i))
            want.append((len(chosen) + 1, mine[at][1], mine[at][0], round(relevance[at], 9), round(value(at), 9)))
            chosen.append(at)
        assert sorted(got[q]) == want


def test_comparison_of_runs(spark):
    r = random.Random(9)
    rows = [(run, q, m, round(r.random() * 5, 4)) for run in range(3) for q in range(60) for m in ("a", "b") if r.random() < 0.8]
    rows += [(0, 900, "c", 1.0), (1, 901, "c", 2.0), (1, 902, "a", None), (0, 902, "a", 2.0), (2, 900, "c", 4.0)]
    frame = spark.createDataFrame(rows, "run_id int, query_id int, metric_name string, value double")
    replicates, seed = 50, 3
    bounds = compare.POISSON
    value = {(run, q, m): round(v * 10_000) for run, q, m, v in rows if v is not None}
    want = {}
    for run in (1, 2):
        for m in "abc":
            pairs = [(q, value[run, q, m], value[0, q, m]) for q in range(1000) if (run, q, m) in value and (0, q, m) in value]
            if not pairs:
                continue
            drawn = []
            for b in range(1, replicates + 1):
                u = [int(hashlib.md5(f"{seed}:{b}:{q}".encode()).hexdigest()[:8], 16) for q, _, _ in pairs]
                times = [sum(x >= bound for bound in bounds) for x in u]
                if n := sum(times):
                    drawn.append(sum(t * (x - y) for t, (_, x, y) in zip(times, pairs)) / n / 10_000)
            drawn.sort()
            cut = int(len(drawn) * 0.1)
            mean = lambda k: sum(p[k] for p in pairs) / len(pairs) / 10_000
            want[run, m] = [len(pairs), mean(2), mean(1), mean(1) - mean(2), *((drawn[cut], drawn[-1 - cut]) if drawn else (None, None))]
    told = compare.compare_runs(frame, 0, replicates, seed, 0.2)
    got = {(x.run_id, x.metric_name): list(x)[2:] for x in told.collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == [v if v is None else pytest.approx(v, abs=1e-9) for v in values]
    # the weights are those of a Poisson variable
    weights = [sum(int(hashlib.md5(f"1:2:{q}".encode()).hexdigest()[:8], 16) >= b for b in bounds) for q in range(20_000)]
    assert abs(np.mean(weights) - 1) < 0.03 and abs(np.var(weights) - 1) < 0.05


def test_rewritten_batches_join_no_postings(spark, monkeypatch):
    chunks, questions = rows_of(13, 150)
    frame = spark.createDataFrame(chunks, "chunk_id bigint, content string").repartition(4)
    asked = spark.createDataFrame(questions, "query_id bigint, question string")
    for search in (rewriting.expanded_search, rewriting.decomposed_search):
        want = sorted(map(tuple, search(sparse.build_index(frame), asked, 5).collect()))
        index = sparse.build_index(frame)
        with monkeypatch.context() as patch:
            patch.setattr(sparse, "PAIRS", 0)
            assert sorted(map(tuple, search(index, asked, 5).collect())) == want
        assert not sparse._exists(spark, f"{index.folder}/postings")


def test_texts_of_candidates_stay_where_they_are(spark):
    # Spark guesses more than it broadcasts by itself
    chunks = spark.range(2000).selectExpr("id AS chunk_id", "repeat(cast(id AS string), 50) AS content")
    found = spark.range(2000).selectExpr("id % 40 AS query_id", "id AS chunk_id", "id AS rank_no", "repeat('x', 30000) AS wide")
    texts = rerank.with_texts(found, chunks)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert texts.filter("content = repeat(cast(chunk_id AS string), 50)").count() == 2000


def test_replicates_are_not_rows(spark, monkeypatch):
    """Pairs are not copied for each replicate: tasks hand on sums, also if they hold few."""
    rows = [(run, q, m, (q * 7 + run) % 50 / 10) for run in range(3) for q in range(3000) for m in "ab"]
    frame = spark.createDataFrame(rows, "run_id int, query_id bigint, metric_name string, value double")
    told = sorted(map(tuple, compare.compare_runs(frame, 0, 20).collect()))
    plan = compare.compare_runs(frame, 0, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "MapInArrow" in plan
    assert [x[2] for x in told] == [3000] * 4
    pairs = spark.createDataFrame([(1, "a", q, 5, 3) for q in range(4000)], "run_id int, metric_name string, query_id int, units bigint, base bigint")
    assert compare._replicates(pairs, 20, 7).count() <= 21 * 8


def test_sums_of_large_scores_are_exact():
    r = random.Random(1)
    for most in (10**4, 10**13, 10**17, 10**19):
        times = np.array([[r.randrange(12) for _ in range(4)] for _ in range(30)], np.uint8)
        values = np.array([[r.randrange(-most, most) for _ in range(3)] for _ in range(30)], object if most > 2**62 else np.int64)
        want = [[sum(int(t[i]) * int(v[c]) for t, v in zip(times, values)) for c in range(3)] for i in range(4)]
        assert compare._product(times, values).tolist() == want


def test_thresholds(spark):
    rows = [(1, "a", 1.0, 0.1, 0.3), (1, "b", 4.0, 0.1, 0.3), (1, "c", 4.0, -0.3, -0.1), (1, "d", 1.0, -0.1, 0.1)]
    compared = spark.createDataFrame(rows, "run_id int, metric_name string, run_mean double, low double, high double")
    limits = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "metric_name string, least double")
    got = {r.metric_name: (r.verdict, r.least) for r in compare.with_thresholds(compared, limits).collect()}
    assert got == {"a": ("below", 2.0), "b": ("better", 2.0), "c": ("worse", None), "d": ("same", None)}
