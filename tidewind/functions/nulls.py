"""Missing values and arithmetic: NULL is the only missing value inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x; NULL where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def complete_sum(x: Column, n: Column | int) -> Column:
    """Aggregate: the sum, or NULL unless all n values are there."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.count(x) == n, F.sum(x))


def rounded(x: Column | str, digits: int = 8) -> Column:
    """Rounded for comparison; -0.0 becomes 0.0."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)
