"""Reproducible pseudo-random numbers computed from keys, equal on every run and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 1_000_000


def uniform(*parts: str | int | Column) -> Column:
    """A number in [0, 1) from the md5 of the parts; columns by name, seeds as integers."""
    columns = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws("_", *[c.cast("string") for c in columns]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % _STEPS) / F.lit(float(_STEPS))


def poisson_one(u: Column) -> Column:
    """A Poisson(1) weight from a uniform number, by its inverse distribution."""
    weight, cumulative, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(10):
        cumulative += term
        term /= k + 1
        weight = weight + F.when(u >= F.lit(cumulative), 1).otherwise(0)
    return weight
