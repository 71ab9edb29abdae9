"""Rounding and ratios as the statistics need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number of a double, halves upwards: floor(x + 0.5), not decimal rounding."""
    return F.floor(x + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, halves upwards; null where the whole is zero or null."""
    return F.when(whole != 0, F.floor(part.cast("double") / whole.cast("double") * 1000 + 0.5) / 10)


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole, or `empty` where the whole is zero or null."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty).cast("double"))


def rounded_mean(total: Column, count: Column) -> Column:
    """Mean as a whole number, halves upwards; null without rows."""
    return F.when(count > 0, half_up(total.cast("double") / count.cast("double"))).cast("long")


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
