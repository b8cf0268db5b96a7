"""Explode without computing the array twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(
    df: DataFrame, array: str | Column, keep: list[str], name: str, pos: str | None = None
) -> DataFrame:
    """One row per element, with ``keep`` columns and optionally its position.

    A plain ``explode`` makes the optimizer add a ``size(array) > 0`` filter and
    push it down, which repeats whatever computes the array - tokenising, a
    Python chunker. The outer form adds no filter; rows of empty arrays are
    dropped by their null element.
    """
    if pos is None:
        element = F.explode_outer(array).alias(name)
    else:
        element = F.posexplode_outer(array).alias(pos, name)
    return df.select(*keep, element).filter(F.col(name).isNotNull())
