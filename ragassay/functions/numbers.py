"""Rounding, fixed-place text and order-independent means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_text(value: Column, places: int) -> Column:
    """``%.Nf`` text as Python writes it.

    The number format rounds the exact value half-even: the double 2.675 lies
    below the tie and prints 2.67, the decimal 2.675 prints 2.68. ``round``,
    ``bround`` and ``format_string`` all go through the shortest decimal form of
    a double and miss that.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def half_even(value: Column, places: int) -> Column:
    """A double rounded to places, with the same rule."""
    return fixed_text(value, places).cast("double")


def exact_mean(value: Column, scale: int = 4) -> Column:
    """Mean of a decimal column as double.

    The sum stays an exact decimal that fits in a long, so the mean does not
    depend on the order in which partitions are merged.
    """
    total = F.sum(value.cast(f"decimal(8,{scale})")).cast("double")
    return total / F.count(value)
