"""Aggregates that replace windows over whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_row_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by arrival order, combined before the shuffle.

    An aggregate instead of ``row_number``: a hot key is reduced in every map
    task, never gathered as a group.
    """
    rest = [c for c in df.columns if c not in keys]
    # a bare null order would be skipped; inside a struct it sorts first
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)
