"""Comparison of settings: paired differences with bootstrap intervals, and thresholds.

Two runs are compared on the queries that both have scored. Instead of drawing queries
again and again, every query counts in each replicate as often as a Poisson variable says
that is hashed from seed, replicate and query. The pairs are dealt by query; a task draws for
each of its queries once and sums all replicates of a run and metric as one product of
matrices, so that a task hands on a row for each replicate, run and metric. Scores are
ten-thousandths, and sums are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

REPLICATES, SEED = 200, 7
#: share of replicates outside of the interval, half on each side
OUTSIDE = 0.05
UNIT = 10_000
#: runs and metrics whose sums (5 KB each at 200 replicates) a task holds before it hands them on
HELD = 10_000

#: a uniform number below 2**32 is k or less if it lies below the k-th of these
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def draws(seed: int, replicates: int, queries: list[str]) -> np.ndarray:
    """Poisson(1) variables, a row for each query; column 0 is the query itself, once."""
    names = [f"{seed}:{b}:".encode() for b in range(1, replicates + 1)]
    digests = b"".join(md5(name + query.encode()).digest()[:4] for query in queries for name in names)
    numbers = np.frombuffer(digests, ">u4").astype(np.int64).reshape(len(queries), replicates)
    times = np.searchsorted(np.array(POISSON), numbers, side="right")
    return np.hstack([np.ones((len(queries), 1), np.int64), times]).astype(np.uint8)


def _product(times: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact sums of times x values: in doubles, 64-bit or unbounded integers by their size."""
    largest = max(abs(int(values.max())), abs(int(values.min())), 1) * len(POISSON) * len(values)
    kind = np.float64 if largest < 2**53 else np.int64 if largest < 2**62 else object
    return (times.T.astype(kind) @ values.astype(kind)).astype(np.int64 if kind is np.float64 else kind)


def _replicates(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """run_id, metric_name, replicate, n, run, base: sums over the queries of a task."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("run_id", "metric_name")}
    schema = f"run_id {kinds['run_id']}, metric_name {kinds['metric_name']}, replicate int, n bigint, run bigint, base bigint"
    empty = pairs.select("run_id", "metric_name", *[F.lit(0).cast(k).alias(c) for c, k in (
        ("replicate", "int"), ("n", "bigint"), ("run", "bigint"), ("base", "bigint"))])
    out = to_arrow_schema(empty.schema)

    def rows(sums: dict) -> pa.RecordBatch:
        every = np.arange(replicates + 1)
        total = [[int(x) for part in sums.values() for x in part[:, c]] for c in range(3)]
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array([key[c] for key in sums for _ in every], out.field(c).type) for c in range(2)),
                pa.array(np.tile(every, len(sums)), pa.int32()), *(pa.array(t, pa.int64()) for t in total),
            ],
            schema=out,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = batch.column("query").dictionary_encode()
            drawn, query = draws(seed, replicates, names.dictionary.to_pylist()), names.indices.to_numpy()
            runs, metrics = (batch.column(c).dictionary_encode() for c in ("run_id", "metric_name"))
            codes = runs.indices.to_numpy().astype(np.int64) * len(metrics.dictionary) + metrics.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            units, base = (batch.column(c).to_numpy() for c in ("units", "base"))
            values = np.stack([np.ones(len(units), np.int64), units, base], axis=1)
            for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []:
                key = (runs[int(at[0])].as_py(), metrics[int(at[0])].as_py())
                part = _product(drawn[query[at]], values[at]).astype(object)
                sums[key] = sums[key] + part if key in sums else part
            if len(sums) > HELD:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    # the rows of a query side by side, so that few batches draw for it again; the work is in the
    # draws, not in the bytes: a number that is given keeps small partitions from being merged
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("query", F.col("query_id").cast("string")).repartition(n, "query").sortWithinPartitions("query")
    return dealt.select("run_id", "metric_name", "query", "units", "base").mapInArrow(run, schema)


def compare_runs(
    scores: DataFrame,
    baseline: int | str,
    replicates: int = REPLICATES,
    seed: int = SEED,
    outside: float = OUTSIDE,
) -> DataFrame:
    """Every run against the baseline run, metric by metric.

    scores: run_id, query_id, metric_name, value (one row for each of the three). Result:
    run_id, metric_name, n_pairs, baseline_mean, run_mean, difference, low, high: means over
    the queries that both runs have, and the interval of the difference (replicates without
    any query are left out). Null scores are no scores; runs without a common query have no
    row.
    """
    units = F.round(F.col("value") * UNIT).cast("bigint")
    known = scores.filter("value IS NOT NULL").select("run_id", "query_id", "metric_name", units.alias("units"))
    base = known.filter(F.col("run_id") == baseline).select("query_id", "metric_name", F.col("units").alias("base"))
    pairs = known.filter(F.col("run_id") != baseline).join(base, ["query_id", "metric_name"])
    # replicate 0 counts every query once
    sums = _replicates(pairs, replicates, seed).groupBy("run_id", "metric_name", "replicate").agg(
        *[F.sum(c).alias(c) for c in ("n", "run", "base")]
    )
    mean = lambda name: F.col(name) / F.col("n") / F.lit(float(UNIT))
    rows = sums.filter("n > 0").select(
        "run_id", "metric_name", "replicate", "n",
        mean("run").alias("run_mean"), mean("base").alias("baseline_mean"),
        ((F.col("run") - F.col("base")) / F.col("n") / F.lit(float(UNIT))).alias("difference"),
    )
    whole = F.col("replicate") == 0
    # one value for each replicate: a bounded array
    drawn_ones = F.sort_array(F.collect_list(F.when(~whole, F.col("difference"))))
    told = rows.groupBy("run_id", "metric_name").agg(
        *[F.max(F.when(whole, F.col(c))).alias(c) for c in ("n", "baseline_mean", "run_mean", "difference")],
        drawn_ones.alias("drawn"),
    )
    n = F.size("drawn")
    low = F.get("drawn", F.floor(n * F.lit(outside / 2)).cast("int"))
    high = F.get("drawn", (n - 1 - F.floor(n * F.lit(outside / 2))).cast("int"))
    return told.select(
        "run_id", "metric_name", F.col("n").alias("n_pairs"), "baseline_mean", "run_mean", "difference",
        low.alias("low"), high.alias("high"),
    )


def with_thresholds(compared: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add least and verdict: how a run stands to the least mean of each metric and to the
    baseline.

    thresholds: metric_name, least; metrics without one have a null there. The verdict is
    below (the mean is under the threshold), else better or worse if the interval has no
    zero, else same.
    """
    rows = compared.join(F.broadcast(thresholds.select("metric_name", "least").limit(1000)), "metric_name", "left")
    verdict = (
        F.when(F.col("run_mean") < F.col("least"), "below")
        .when(F.col("low") > 0, "better")
        .when(F.col("high") < 0, "worse")
        .otherwise("same")
    )
    return rows.withColumn("verdict", verdict)
