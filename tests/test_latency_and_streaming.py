"""Quantile sketches against sorted values; a stream with a crash against one batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ragassay.operators import diagnose, latency
from ragassay.plans.diagnosis import build_reports
from ragassay.schemas import METRICS
from ragassay.sources import store
from ragassay.streaming import chats

START = datetime.datetime(2024, 5, 1)
TURNS = "conv_id bigint, turn int, role string, text string, at timestamp"


def test_sketches_keep_to_their_rank_error(spark):
    r = random.Random(1)
    values = [(run, 10_000 * run + q, r.paretovariate(1.2)) for run in range(4) for q in range(9000)]
    rows = spark.createDataFrame(values, "run_id int, query_id int, latency double")
    micros = (F.col("latency") * 1_000_000).cast("bigint")
    start = F.lit(START).cast("timestamp")
    history = rows.select(
        "query_id", F.lit("q").alias("question"), F.lit("a").alias("generated_answer"),
        start.alias("query_time"), F.timestamp_micros(F.unix_micros(start) + micros).alias("response_time"),
    )
    sketches = latency.run_sketches(rows, history)
    for told, mine in (
        (latency.profile(sketches), lambda run: lambda v: v[0] == run),
        (latency.profile(latency.merged(sketches)).withColumn("run_id", F.lit(-1)), lambda run: lambda v: True),
    ):
        for row in told.collect():
            own = sorted(v[2] for v in values if mine(row.run_id)(v))
            assert row.n == len(own)
            for name, share in latency.QUANTILES.items():
                rank = sum(v <= row[name] + 1e-6 for v in own) / len(own)
                assert abs(rank - share) <= latency.RANK_ERROR


def test_small_and_empty_sets_are_exact(spark):
    rows = [(1, q, START, None if q == 9 else START + datetime.timedelta(seconds=q)) for q in range(1, 10)] + [(2, 50, START, None)]
    frame = spark.createDataFrame(rows, "run_id int, query_id int, query_time timestamp_ntz, response_time timestamp_ntz")
    history = frame.withColumns({"question": F.lit(None).cast("string"), "generated_answer": F.lit("four")})
    got = {r.run_id: r for r in latency.profile(latency.run_sketches(frame, history)).collect()}
    assert (got[1].n, got[1].p50, got[1].p90, got[1].p99) == (8, 4.0, 8.0, 8.0)
    assert (got[2].n, got[2].p50) == (0, None) and got[2].cost == pytest.approx(4 * 0.3 / 1e6)
    jobs = spark.createDataFrame([("j", 1), ("k", 7)], "job_id string, inference_run_id int")
    (job,) = latency.job_latencies(jobs, latency.run_sketches(frame, history)).collect()
    assert (job.job_id, job.latency_seconds) == ("j", 4.0)


def test_reports_with_measured_times(spark):
    averages = spark.createDataFrame([(j, 1.0, 0.0, 0.0, 0.0, 0.0) for j in "ab"], "job_id string, " + ", ".join(f"{m} double" for m in METRICS))
    metadata = spark.createDataFrame([(j, "s", "d") for j in "ab"], "job_id string, setting_id string, dataset_name string")
    measured = spark.createDataFrame([("a", 3.5, 0.25)], "job_id string, latency_seconds double, cost_estimate double")
    told = diagnose.reports(averages, metadata, diagnose.standard_rules(), measured)
    got = {r.job_id: r.report.overall_summary for r in told.collect()}
    assert (got["a"].latency_seconds, got["a"].cost_estimate) == (3.5, 0.25)
    assert (got["b"].latency_seconds, got["b"].cost_estimate) == (diagnose.LATENCY_SECONDS, diagnose.COST_ESTIMATE)


def turns_of(convs, minutes=0):
    rows = []
    for c in convs:
        for t in range(6):
            at = START + datetime.timedelta(minutes=minutes + 2 * t, seconds=c)
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", None if t == 4 else f"turn {t} about {c}", at))
    return rows


def write(spark, folder, rows):
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(folder)


def state(spark, root):
    history = store.read(spark, root, "query_history").select("query_id", "question", "generated_answer", "query_time")
    scores = store.read(spark, root, "evaluation_metrics").select("query_id", "metric_name", "metric_value", "reasoning", "job_id", "id")
    return sorted(map(tuple, history.collect())), sorted(map(tuple, scores.collect()))


def test_a_crashed_stream_ends_like_one_batch(spark, folder, monkeypatch):
    source, root = f"{folder}/in", f"{folder}/root"
    first, second = turns_of(range(8)), turns_of(range(8, 14), 7)
    # a pair that is parted over both files, a turn that comes again, late and odd ones
    first.append((99, 0, "user", "parted question", START))
    second += [(99, 1, "assistant", "its answer", START + datetime.timedelta(minutes=4)), first[1]]
    second += [(98, 0, "user", "too slow", START), (98, 1, "assistant", "after hours", START + datetime.timedelta(hours=3))]
    second += [(None, 0, "user", "x", START), (97, 3, "system", "x", START)]
    whole = f"{folder}/whole"
    chats.write_batch(chats.paired_turns(spark.createDataFrame(first + second, TURNS)), whole, "chat_stream", 0)

    def run():
        stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(source)
        query = chats.evaluate_stream(stream, root, f"{folder}/checkpoint")
        query.awaitTermination()

    write(spark, source, first)
    publish, failed = store.publish, []

    def crash(*args, **options):
        failed.append(1)
        raise RuntimeError("crash before the version is written")

    monkeypatch.setattr(store, "publish", crash)
    with pytest.raises(Exception, match="crash before"):
        run()
    assert failed and store.current_version(spark, root) == 0
    monkeypatch.setattr(store, "publish", publish)
    run()
    assert 0 < len(state(spark, root)[0]) < len(state(spark, whole)[0])
    write(spark, source, second)
    run()
    run()  # nothing new
    assert state(spark, root) == state(spark, whole)
    questions = {q for _, q, _, _ in state(spark, root)[0]}
    assert "parted question" in questions and "too slow" not in questions
    # a batch that is run again after it was listed changes nothing
    before = store.current_version(spark, root)
    chats.write_batch(chats.paired_turns(spark.createDataFrame(first, TURNS)), root, "chat_stream", 0)
    assert store.current_version(spark, root) == before


def test_streamed_queries_show_in_reports(spark, folder):
    chats.write_batch(chats.paired_turns(spark.createDataFrame(turns_of(range(3)), TURNS)), folder, "chat_stream", 0)
    scored = store.read(spark, folder, "evaluation_metrics")
    assert scored.count() == 27 and {r.evaluation_strategy for r in scored.collect()} == {"CASE2_RAG_TRIAD"}
    jobs = scored.select("job_id").distinct()
    (report,) = build_reports(spark, folder, jobs, measured=True).collect()
    assert report.report.stage_metrics.generation.answer_relevance > 0
