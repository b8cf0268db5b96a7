"""Judge chat logs as they arrive.

Turns (conv_id, turn, role, text, at) come as a stream. A user turn waits for the
assistant's next turn in the state of a stream join, as long as the watermark allows; each
pair becomes a logged query and is judged without ground truth. A micro-batch is written as
one load of each table, named after the stream and the batch, and listed by one version: a
batch that is run again after a crash overwrites what it had written and is listed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragassay.functions.text import stable_id
from ragassay.operators import evaluate
from ragassay.sources import store

#: how long a user turn may wait for its answer, and how late turns may come
PATIENCE, LATENESS = "1 hour", "2 hours"


def paired_turns(turns: DataFrame, patience: str = PATIENCE, lateness: str = LATENESS) -> DataFrame:
    """query_id, question, generated_answer, query_time, response_time of each user turn and
    the assistant's turn numbered next, at most `patience` later.

    turns is a stream or a table; `at` is its event time. Turns without a text pair as
    empty ones; turns that are null in conv_id, turn or at never pair. A turn that comes
    twice pairs twice, with one query_id.
    """
    text = F.coalesce("text", F.lit(""))
    asked = turns.filter("role = 'user'").withWatermark("at", lateness).select(
        "conv_id", "turn", text.alias("question"), F.col("at").alias("query_time")
    )
    replied = turns.filter("role = 'assistant'").withWatermark("at", lateness).select(
        F.col("conv_id").alias("_conv"), (F.col("turn") - 1).alias("_turn"),
        text.alias("generated_answer"), F.col("at").alias("response_time"),
    )
    met = asked.join(
        replied,
        F.expr(
            "conv_id = _conv AND turn = _turn AND response_time >= query_time "
            f"AND response_time <= query_time + INTERVAL {patience}"
        ),
    )
    return met.select(
        stable_id(F.lit("chat"), F.col("conv_id"), F.col("turn")).alias("query_id"),
        "question", "generated_answer", "query_time", "response_time",
    )


def _listed(spark: SparkSession, root: str, load: str) -> bool:
    return not store.versions(spark, root).filter(F.col("load") == load).isEmpty()


def write_batch(pairs: DataFrame, root: str, name: str, number: int, triad: evaluate.Scorer | None = None) -> None:
    """Log and judge the pairs of one micro-batch, once however often it is run."""
    spark = pairs.sparkSession
    load = f"{name}-{number:010d}"
    if _listed(spark, root, load):
        return
    # one row for each query, also if a turn came twice
    rows = pairs.groupBy("query_id").agg(
        F.min(F.struct("response_time", "generated_answer", "question", "query_time")).alias("r")
    )
    rows = rows.select("query_id", "r.*", F.lit(name).alias("queried_by"))
    known = store.read(spark, root, "query_history").select("query_id")
    store.write_part(rows.join(known, "query_id", "left_anti"), root, "query_history", name, load)
    fresh = store.read_part(spark, root, "query_history", spark.createDataFrame([(load,)], "load string"))
    if fresh.isEmpty():
        return
    fresh = fresh.select("query_id", "question", "generated_answer").withColumns(
        {
            "retrieved_contexts": F.array().cast("array<struct<text:string>>"),
            "ground_truth": F.lit(None).cast("string"),
        }
    )
    judged = evaluate.judged(fresh, None, triad).withColumn("job_id", stable_id(F.lit("stream"), F.lit(name)))
    scored = evaluate.metric_rows(judged, arrival=[]).withColumn(
        "id", stable_id(*[F.col(c) for c in evaluate.METRIC_KEY])
    )
    store.write_part(scored, root, "evaluation_metrics", name, load)
    base = store.current_version(spark, root)
    store.publish(spark, root, base, append={"query_history": [load], "evaluation_metrics": [load]})


def evaluate_stream(
    turns: DataFrame,
    root: str,
    checkpoint: str,
    name: str = "chat_stream",
    triad: evaluate.Scorer | None = None,
    **trigger,
) -> StreamingQuery:
    """Start judging a stream of turns into the tables below root.

    The checkpoint folder holds what was read and the turns that wait; a query started
    again with it goes on where the last one ended. By default all that is there is read,
    then the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, root, name, number, triad)

    return (
        paired_turns(turns)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
