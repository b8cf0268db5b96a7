"""Versioned load, benchmark batches, inference rows."""

import pytest
from pyspark.sql import functions as F

from ragassay.functions.aggregates import first_row_per_key
from ragassay.functions.text import name_uuid
from ragassay.operators import golden, inference, ingest


def state(df, key):
    return {r[key]: (r.is_deleted, r.newly_deleted) for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(
        [("d1", "a.pdf", False), ("d2", "a.pdf", True), ("d3", "b.pdf", False), ("d4", "a.pdf", None)],
        "doc_id string, doc_name string, is_deleted boolean",
    )
    chunks = spark.createDataFrame(
        [("k1", "d1", False), ("k2", "d1", True), ("k3", "d2", False), ("k4", "d3", False)],
        "chunk_id string, doc_id string, is_deleted boolean",
    )
    topics = spark.createDataFrame(
        [("d1", "t1", False), ("d3", "t1", False)], "doc_id string, topic_id string, is_deleted boolean"
    )
    return docs, chunks, topics


def test_soft_delete_cascade(spark, tables):
    incoming = spark.createDataFrame([("a.pdf",), ("new.pdf",), ("a.pdf",)], "doc_name string")
    documents, chunks, topics = tables
    retired = ingest.retired_documents(documents, incoming)
    assert state(ingest.soft_deleted(documents, retired), "doc_id") == {
        "d1": (True, True), "d2": (True, False), "d3": (False, False), "d4": (None, False),
    }
    assert state(ingest.soft_deleted(chunks, retired), "chunk_id") == {
        "k1": (True, True), "k2": (True, False), "k3": (False, False), "k4": (False, False),
    }
    assert state(ingest.soft_deleted(topics, retired), "doc_id") == {"d1": (True, True), "d3": (False, False)}
    assert [r.doc_id for r in retired.collect()] == ["d1"]


def test_batch_with_a_repeated_name_equals_one_by_one_loading(spark, tables):
    arrivals = spark.createDataFrame(
        [(1, "n1", "a.pdf", ["x"]), (2, "n2", "a.pdf", ["x", "y"]), (3, "n3", "c.pdf", ["y"])],
        "seq int, doc_id string, doc_name string, topics array<string>",
    )
    versions = ingest.new_document_versions(arrivals, "seq")
    assert {r.doc_id: r.is_deleted for r in versions.collect()} == {"n1": True, "n2": False, "n3": False}
    counts = spark.createDataFrame([("n1", 5), ("n2", 7), ("n3", 1)], "doc_id string, n_chunks int")
    known = spark.createDataFrame([("x",)], "topic_name string")
    documents, chunks, topics = tables
    retired = ingest.retired_documents(documents, arrivals)
    rows = ingest.ingest_stats(retired, chunks, topics, versions, known, counts, order="seq").collect()
    got = {r.doc_name: tuple(r)[1:] for r in rows}
    # deleted documents, chunks, topics; inserted documents, topics, topic rows, chunks
    assert got == {"a.pdf": (2, 6, 2, 2, 1, 3, 12), "c.pdf": (0, 0, 0, 1, 0, 1, 1)}


def test_topics_are_inserted_revived_or_kept(spark):
    old = spark.createDataFrame(
        [("old", False), ("gone", True), ("rest", True)], "topic_name string, is_deleted boolean"
    ).withColumn("topic_id", name_uuid(F.col("topic_name")))
    new = spark.createDataFrame([("gone",), ("new",), ("new",)], "topic_name string")
    rows = ingest.topics_upsert(old, new).collect()
    assert {r.topic_name: (r.is_deleted, r.was_inserted) for r in rows} == {
        "old": (False, False), "gone": (False, False), "rest": (True, False), "new": (False, True),
    }


def test_topic_named_twice_fails(spark):
    docs = spark.createDataFrame([("d", ["x", "x"])], "doc_id string, topics array<string>")
    with pytest.raises(Exception, match="same topic twice"):
        ingest.document_topics_map(docs).collect()


def test_batch_inserted_twice_leaves_one_active_version(spark):
    empty = spark.createDataFrame(
        [], "id string, batch_name string, question string, ground_truth string, expected_topics array<string>, complexity string, is_deleted boolean"
    )

    def pairs(tag):
        return spark.createDataFrame([(1, f"q {tag}", "a", "Factoid")], "k int, question string, answer string, complexity string")

    v1 = golden.replace_batch(empty, golden.golden_rows(pairs("one"), "b1", ["k"]))
    v2 = golden.replace_batch(v1, golden.golden_rows(pairs("two"), "b1", ["k"]))
    assert {r.question: r.is_deleted for r in v2.collect()} == {"q one": True, "q two": False}
    assert [r.question for r in golden.fetch_batch(v2, "b1").collect()] == ["q two"]
    unchanged = golden.replace_batch(v2, golden.golden_rows(pairs("x").filter("k < 0"), "b1", ["k"]))
    assert {r.question: r.is_deleted for r in unchanged.collect()} == {"q one": True, "q two": False}


def test_refused_pairs(spark):
    rows = [
        ("INVALID_CHUNK", "x"), ("about INVALID_CHUNK?", "x"), ("ok", "REJECTED"), ("ok", "not REJECTED"), ("ok", "fine"),
    ]
    pairs = spark.createDataFrame(rows, "question string, answer string")
    assert [r.answer for r in golden.accepted(pairs).collect()] == ["not REJECTED", "fine"]


def test_failing_generator_loses_only_its_chunk(spark):
    def generate(text):
        if "bad" in text:
            raise RuntimeError("model error")
        return f"What is {text}?", text, "Factoid"

    df = spark.createDataFrame([("good",), ("bad",)], "content string")
    pairs = df.select(golden.generated_qa(generate)("content").alias("qa")).select("qa.*")
    assert [tuple(r) for r in golden.accepted(pairs).collect()] == [("What is good?", "good", "Factoid")]


def test_fetch_batch_limit_and_topics(spark):
    rows = [(i, "b", None if i else ["t"], i == 2) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, batch_name string, expected_topics array<string>, is_deleted boolean")
    assert [r.id for r in golden.fetch_batch(df, "b", 2).collect()] == [0, 1]
    assert golden.fetch_batch(df, "b", 0).count() == 4
    assert [r.expected_topics for r in golden.fetch_batch(df, "b", 2).collect()] == [["t"], []]


def test_sample_is_reproducible_and_bounded(spark):
    df = spark.range(1000).withColumnRenamed("id", "chunk_id")
    a = {r[0] for r in golden.sample(df, 20, 1, by=("chunk_id",)).collect()}
    b = {r[0] for r in golden.sample(df.repartition(7), 20, 1, by=("chunk_id",)).collect()}
    assert a == b and len(a) == 20
    assert golden.sample(df, 20).count() == 20


def test_worklist_modes(spark):
    rows = [("g1", "b", "q1", False), ("g2", "b", "q2", True)]
    records = spark.createDataFrame(rows, "id string, batch_name string, question string, is_deleted boolean").withColumn(
        "expected_topics", F.lit(None).cast("array<string>")
    )
    case1 = inference.worklist("case1", records, "b").collect()
    assert [(r.question, r.golden_record_id) for r in case1] == [("q1", "g1")]
    asked = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "ordinal int, question string")
    case2 = inference.worklist("case2", questions=asked, limit=2).collect()
    assert [(r.item, r.question, r.golden_record_id) for r in case2] == [("0", "x", None), ("1", "y", None)]
    none = asked.filter("ordinal < 0")
    for bad in (dict(mode="case1"), dict(mode="case2"), dict(mode="case2", questions=none), dict(mode="other")):
        with pytest.raises(ValueError):
            inference.worklist(**bad)


def test_inference_rows_per_table(spark):
    results = spark.createDataFrame(
        [("r", "q1", "g1"), ("r", "q2", None)], "run_id string, query_id string, golden_record_id string"
    )
    run = spark.createDataFrame([("r",), ("other",)], "run_id string")
    tables = inference.inference_tables(run, results)
    assert {name: t.count() for name, t in tables.items()} == {
        "inference_run_history": 1, "query_history": 2, "inference_run_query_mapping": 2, "golden_record_query_mapping": 1,
    }
    assert tuple(inference.run_summary(results).first()) == ("r", 1, 2, 2, 1)
    nothing = inference.inference_tables(run, results.limit(0))
    assert all(t.count() == 0 for t in nothing.values())


def test_first_row_per_key_with_null_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2, 2), ("b", 5, 3), ("b", 4, 4)], "k string, o int, v int")
    got = {r.k: r.v for r in first_row_per_key(df, ["k"], "o").collect()}
    assert got == {"a": 1, "b": 4}
