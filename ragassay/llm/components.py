"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """node, label: each linked node with the smallest node it can reach.

    links: a, b of one orderable type, in any direction, repeated or not. Each round
    takes the smallest label among the neighbours and then that label's own label,
    so that chains shorten by more than half; rounds end when no label changes.
    """
    both = durable(_both_ways(links))
    labels = durable(one_step(links))
    while True:
        heard = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("heard"))
        )
        nearer = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", "label", F.least("label", "heard").alias("near")
        )
        own = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = durable(
            nearer.join(own, "near").select(
                "node",
                F.least("near", "far").alias("label"),
                (F.least("near", "far") < F.col("label")).alias("moved"),
            )
        )
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels


def _both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.select("a", "b").union(back).filter("a <> b")


def one_step(links: DataFrame) -> DataFrame:
    """node, label: the smallest of each linked node and its neighbours."""
    least = _both_ways(links).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other"))
    return least.select("node", F.least("node", "other").alias("label"))
