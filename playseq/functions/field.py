"""Field-position expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_position(yards_to_endzone: Column) -> Column:
    """Distance to the end zone as a signed yard line: own half negative, midfield -50, unknown 0."""
    y = yards_to_endzone
    return F.when(y.isNull(), F.lit(0)).when(y >= 50, y - 100).otherwise(y).cast("int")


def yards_to_endzone(position: Column) -> Column:
    """Inverse of :func:`signed_position` for a known (non-zero) position."""
    return F.when(position < 0, position + 100).otherwise(position)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
