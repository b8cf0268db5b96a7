"""The stages one after the other, each against brute force on its own input."""

from test_classifier_and_packing import check_packing
from test_dedup import WORD, in_order, kept_lines, later_windows, near

import corpus_pipeline
from ragassay.llm import nbsvm
from ragassay.session import durable


def rows_of(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, found = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = durable(stage(spark, docs, sf))
        before, docs = docs, found[name]
        if name == "best_fit_packing":
            break
        assert docs.columns == columns and docs.count() > 0
        rows, left = rows_of(before), rows_of(docs)
        if name == "quality":
            model = nbsvm.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert left == [(i, t) for i, t in rows if model.score(nbsvm.features(t)) >= 0.5]
        if name == "line_dedup":
            assert left == sorted((i, t) for (i, _), t in kept_lines(in_order(spark, rows), 3, 5).items())
        if name == "near_dedup":
            groups = {i: c for i, _, c in near(rows, 5)}
            assert left == [(i, t) for i, t in rows if groups[i] == i]
        if name == "passage_dedup":
            ordered = in_order(spark, rows)
            tokens = [WORD.findall(t) for _, t, _ in ordered]
            gone = {(at, s + k) for at, s in later_windows(tokens, 50) for k in range(50)}
            want = {i: [w for k, w in enumerate(tokens[at]) if (at, k) not in gone] for at, (i, _, _) in enumerate(ordered)}
            assert {i: WORD.findall(t) for i, t in left} == want
    rows = rows_of(found["passage_dedup"])
    used, bound = check_packing(rows, found["best_fit_packing"].collect(), 4096)
    assert used <= bound + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == sorted(
        map(tuple, found["best_fit_packing"].select("doc_id", "piece", "ids_crc32").collect())
    )
