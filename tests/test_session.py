"""Intermediate tables and where they go."""

import os

from ragassay.session import durable, scratch


def test_scratch_is_cleared(spark, folder):
    rows = spark.range(10)
    with scratch(spark) as own:
        table = durable(rows.selectExpr("id * 2 AS twice"))
        place = own.removeprefix("file:")
        assert len([n for n in os.listdir(place)]) == 1
        with scratch(spark) as inner:
            assert inner != own and durable(rows).count() == 10
        assert not os.path.exists(inner.removeprefix("file:"))
        table.write.parquet(f"{folder}/out")
    assert not os.path.exists(place)
    assert spark.read.parquet(f"{folder}/out").count() == 10
    kept = durable(rows)
    assert kept.count() == 10 and kept.inputFiles()[0].count("ragassay") >= 1
