"""Exact search against brute force, filters, ties, blocks and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragassay.operators import inference, retrieve
from ragassay.schemas import NO_ANSWER

D = 6


@pytest.fixture(scope="module")
def world(spark):
    """Random vectors with many exact copies: a third of all chunks is one vector."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, D)).astype(np.float32)
    vectors[::3] = vectors[0]
    vectors[7] = 0.0
    rows = [
        (f"c{i:03d}", i // 4, [float(x) for x in v], i % 11 == 0) for i, v in enumerate(vectors)
    ]
    rows.append(("c999", 1, None, False))
    chunks = spark.createDataFrame(
        rows, "chunk_id string, doc_id int, embedding array<float>, is_deleted boolean"
    ).repartition(5)
    docs = spark.createDataFrame(
        [(d, d % 7 == 0) for d in range(70)], "doc_id int, is_deleted boolean"
    )
    maps = [(d, t, d % 13 == 0) for d in range(75) for t in ("red", "blue")[: d % 3]]
    topics = spark.createDataFrame(
        [("red", False), ("blue", False), ("gone", True)], "topic_name string, is_deleted boolean"
    )
    doc_topics = spark.createDataFrame(
        maps + [(3, "gone", False)], "doc_id int, topic_name string, is_deleted boolean"
    )
    asked = rng.normal(size=(12, D)).astype(np.float32)
    asked[0] = vectors[0]
    queries = [(i, [float(x) for x in v]) for i, v in enumerate(asked)]
    return dict(rows=rows, chunks=chunks, docs=docs, maps=maps, topics=topics, doc_topics=doc_topics, queries=queries)


def brute(world, k=5, threshold=0.0, names=None, distinct=False, params=None):
    out = {}
    for qid, q in world["queries"]:
        kk, th, tn = (params or {}).get(qid, (k, threshold, names))
        q64 = np.array(np.float32(q), dtype=np.float64)
        hits = []
        for cid, doc, v, deleted in world["rows"]:
            if deleted or v is None or doc >= 70 or doc % 7 == 0:
                continue
            v64 = np.array(np.float32(v), dtype=np.float64)
            if not v64.any():
                continue
            sim = v64 @ q64 / np.linalg.norm(v64) / np.linalg.norm(q64)
            copies = 1
            if tn:
                copies = sum(1 for d, t, gone in world["maps"] if d == doc and t in tn and not gone)
                copies = min(copies, 1) if distinct else copies
            if sim >= th - 1e-12:
                hits += [(-round(sim, 9), cid)] * copies
        out[qid] = [c for _, c in sorted(hits)[:kk]]
    return {q: c for q, c in out.items() if c}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank_no").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def ask(spark, world, extra=None):
    df = spark.createDataFrame(world["queries"], "query_id long, embedding array<float>")
    return df if extra is None else extra(df)


@pytest.mark.parametrize("k", [1, 5, 200])
def test_top_k_matches_brute_force(spark, world, k):
    got = retrieve.semantic_search(ask(spark, world), world["chunks"], world["docs"], top_k=k, threshold=0.1)
    assert found(got) == brute(world, k, 0.1)


@pytest.mark.parametrize("distinct", [False, True])
def test_topic_filter_multiplicity(spark, world, distinct):
    queries = ask(spark, world, lambda d: d.withColumn("topic_filters", F.array(F.lit("red"), F.lit("blue"), F.lit("gone"))))
    got = retrieve.semantic_search(
        queries, world["chunks"], world["docs"], world["doc_topics"], world["topics"],
        topic_key="topic_name", distinct_topics=distinct, threshold=0.0,
    )
    assert found(got) == brute(world, 5, 0.0, ("red", "blue"), distinct)


def test_overrides_per_question(spark, world):
    params = {
        i: (1 + i % 4, 0.3 if i % 2 else 0.0, ("red",) if i % 3 == 0 else None) for i in range(12)
    }
    rows = [(i, v, params[i][0], params[i][1], list(params[i][2]) if params[i][2] else None) for i, v in world["queries"]]
    queries = spark.createDataFrame(
        rows, "query_id long, embedding array<float>, top_k int, similarity_threshold double, topic_filters array<string>"
    )
    got = retrieve.semantic_search(
        queries, world["chunks"], world["docs"], world["doc_topics"], world["topics"], topic_key="topic_name"
    )
    assert found(got) == brute(world, params=params)


def test_empty_topic_list_means_no_filter(spark, world):
    queries = ask(spark, world, lambda d: d.withColumn("topic_filters", F.array().cast("array<string>")))
    got = retrieve.semantic_search(queries, world["chunks"], world["docs"], threshold=0.1)
    assert found(got) == brute(world, 5, 0.1)


@pytest.mark.parametrize("limit", [1000, 1])
def test_unknown_and_null_topics_match_nothing(spark, world, monkeypatch, limit):
    monkeypatch.setattr(retrieve, "TOPIC_LIST", limit)
    queries = ask(spark, world, lambda d: d.withColumn(
        "topic_filters",
        F.when(F.col("query_id") == 0, F.array(F.lit(None).cast("string")))
        .when(F.col("query_id") == 1, F.array(F.lit("unknown"), F.lit(None)))
        .otherwise(F.array(F.lit("red"), F.lit("red"))),
    ))
    tables = (world["chunks"], world["docs"], world["doc_topics"], world["topics"])
    got = found(retrieve.semantic_search(queries, *tables, topic_key="topic_name", threshold=0.0))
    want = brute(world, 5, 0.0, ("red",))
    assert got == {q: c for q, c in want.items() if q > 1}
    only_null = queries.filter("query_id = 0")
    assert retrieve.semantic_search(only_null, *tables, topic_key="topic_name", threshold=0.0).count() == 0


def test_many_query_blocks_give_the_same_result(spark, world):
    asked = retrieve.with_search_defaults(ask(spark, world))
    parts = retrieve.query_parts(asked, block_bytes=3 * (8 * D + 256))
    sizes = [part.count() for part in parts]
    assert len(parts) >= 4 and max(sizes) <= 3 and sum(sizes) == 12
    got = retrieve.semantic_search(
        ask(spark, world), world["chunks"], world["docs"], threshold=0.1, block_bytes=3 * (8 * D + 256)
    )
    assert found(got) == brute(world, 5, 0.1)


def test_threshold_join_in_blocks(spark, world):
    chunks = world["chunks"].filter("embedding IS NOT NULL")
    one = retrieve.similar_pairs(ask(spark, world), chunks, 0.4)
    many = retrieve.similar_pairs(ask(spark, world), chunks, 0.4, block_bytes=4 * (8 * D + 256))
    assert sorted(one.collect()) == sorted(many.collect())


def test_repeated_query_ids_beyond_a_block_are_refused(spark):
    queries = spark.createDataFrame([(1, [1.0])] * 40, "query_id long, embedding array<float>")
    with pytest.raises(ValueError, match="unique"):
        retrieve.query_parts(retrieve.with_search_defaults(queries), block_bytes=3 * (8 + 256))


def test_threshold_join_returns_every_pair(spark, world):
    chunks = world["chunks"].filter("embedding IS NOT NULL")
    got = {(r.query_id, r.chunk_id) for r in retrieve.similar_pairs(ask(spark, world), chunks, 0.4).collect()}
    want = set()
    for qid, q in world["queries"]:
        for cid, _, v, _ in world["rows"]:
            if v is not None and any(v):
                sim = np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)
                if sim >= 0.4:
                    want.add((qid, cid))
    assert got == want


def test_no_questions_and_zero_vectors(spark, world):
    none = ask(spark, world).filter("query_id < 0")
    assert retrieve.semantic_search(none, world["chunks"], world["docs"]).count() == 0
    zero = spark.createDataFrame([(1, [0.0] * D), (2, None)], "query_id long, embedding array<float>")
    assert retrieve.semantic_search(zero, world["chunks"], world["docs"], threshold=-1.0).count() == 0


def test_dimension_mismatch_fails(spark, world):
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        retrieve.semantic_search(queries, world["chunks"], world["docs"]).count()


def test_threshold_and_metadata_of_hits(spark):
    chunks = spark.createDataFrame(
        [("a", "d", [0.85, 0.5268], "first", 1, False), ("b", "d", [0.76, 0.65], "second", 2, False), ("c", "d", [0.7, 0.7141], "third", 3, False)],
        "chunk_id string, doc_id string, embedding array<float>, content string, page_number int, is_deleted boolean",
    )
    docs = spark.createDataFrame([("d", False)], "doc_id string, is_deleted boolean")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    hits = retrieve.semantic_search(queries, chunks, docs, top_k=3, threshold=0.75)
    rows = retrieve.with_chunk_text(hits, chunks).orderBy("rank_no").collect()
    assert [(r.chunk_id, r.content, r.page_number, round(r.similarity_score, 2)) for r in rows] == [
        ("a", "first", 1, 0.85), ("b", "second", 2, 0.76),
    ]
    assert retrieve.semantic_search(queries, chunks, docs, threshold=1.1).count() == 0


def test_vectors_are_not_shuffled_and_no_cross_join(spark, world):
    got = retrieve.semantic_search(ask(spark, world), world["chunks"], world["docs"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    below_scan = plan[plan.index("MapInArrow") :]
    assert "Exchange hashpartitioning(doc_id" not in below_scan


def test_large_document_list_falls_back_to_a_shuffled_join(spark, world, monkeypatch):
    monkeypatch.setattr(retrieve, "LIVE_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = retrieve.semantic_search(ask(spark, world), world["chunks"], world["docs"], threshold=0.1)
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        assert found(got) == brute(world, 5, 0.1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_question_without_context_gets_the_apology(spark):
    kind = "array<struct<text:string>>"
    asked = spark.createDataFrame([(1, []), (2, [("fact",)])], f"query_id int, retrieved_contexts {kind}")
    rows = {r.query_id: r.generated_answer for r in inference.answered(asked).collect()}
    assert rows == {1: NO_ANSWER, 2: "fact"}


def test_model_is_not_called_without_context(spark):
    kind = "array<struct<text:string,similarity_score:double,metadata:struct<page_number:int,token_count:int>>>"
    asked = spark.createDataFrame(
        [(1, "q", []), (2, "q", [("fact", 0.99, (1, None))])], f"query_id int, question string, retrieved_contexts {kind}"
    )

    def echo(prompt):
        assert "fact" in prompt
        return prompt

    answer = inference.model_answer(echo)(F.col("retrieved_contexts"), F.col("question"))
    rows = {r.query_id: r.generated_answer for r in inference.answered(asked, answer).collect()}
    assert rows[1] == NO_ANSWER
    assert "[Source 1 | Score: 0.9900 | page_number=1, token_count=None]\nfact" in rows[2]
