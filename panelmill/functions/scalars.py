"""Null-aware arithmetic: NULL means "does not own the product"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zero(x: str | Column) -> Column:
    """The value, NULL read as 0."""
    return F.coalesce(_col(x), F.lit(0))


def null_safe_sum(*columns: str | Column) -> Column:
    return reduce(lambda a, b: a + b, [zero(c) for c in columns])


def positive(x: str | Column) -> Column:
    return (zero(x) > 0).cast("int")


def count_positive(*columns: str | Column) -> Column:
    return reduce(lambda a, b: a + b, [positive(c) for c in columns])


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """NULL numerator counts as 0; zero or NULL denominator gives NULL."""
    return F.try_divide(zero(a).cast("double"), zero(b).cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """NULL stays NULL on either side; zero denominator gives NULL."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def clamped_ratio(a: str | Column, b: str | Column, floor: float = 0.0) -> Column:
    """`ratio` with the denominator raised to at least `floor` (0 then gives NULL)."""
    return ratio(a, F.greatest(_col(b), F.lit(floor)))


def flag(condition: Column) -> Column:
    """1 / 0, NULL when the condition is unknown."""
    return condition.cast("int")


def sure_flag(condition: Column) -> Column:
    """1 / 0, with an unknown condition as 0."""
    return F.when(condition, 1).otherwise(0)


def signed_growth(now: Column, before: Column) -> Column:
    """Change over the size of the old value; the sign survives a negative base."""
    return F.try_divide((now - before).cast("double"), F.abs(before).cast("double"))
