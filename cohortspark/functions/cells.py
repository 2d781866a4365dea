"""Expressions that tell present values from missing ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """The value, or null where it is null or not-a-number. For columns of a floating type."""
    return F.when(~F.isnan(value), value)


def on_scale(value: Column, low: float, high: float) -> Column:
    """The value, or null where it is null, not-a-number or outside `low` to `high`.

    Spark orders not-a-number above every number, so the upper bound removes it too.
    """
    return F.when((value >= F.lit(low)) & (value <= F.lit(high)), value)
