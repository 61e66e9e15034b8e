"""Arithmetic on integer YYYYMM periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_index(period: Column) -> Column:
    """YYYYMM -> months since year 0."""
    return (F.floor(period / 100) * 12 + period % 100 - 1).cast("int")


def index_period(index: Column) -> Column:
    """Months since year 0 -> YYYYMM."""
    return (F.floor(index / 12) * 100 + index % 12 + 1).cast("int")


def add_periods(period: Column, n: int | Column) -> Column:
    return index_period(period_index(period) + n)


def periods_between(start: Column, end: Column) -> Column:
    return (period_index(end) - period_index(start)).cast("int")


def year_month(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")
