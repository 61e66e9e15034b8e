"""Repair rules for known data faults. Each returns the repaired column; apply before lags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.scalars import null_safe_sum, zero
from panelmill.operators.history import history


def null_in_periods(column: str, periods: Sequence[int]) -> Column:
    """A column broken in some periods becomes NULL there."""
    return F.when(F.col(K.PERIOD).isin(*periods), None).otherwise(F.col(column))


def merged(*columns: str | Column) -> Column:
    """Sum of columns between which rows were reclassified."""
    return null_safe_sum(*columns)


def sentinel_to_null(column: str, below: float) -> Column:
    return F.when(F.col(column) < below, None).otherwise(F.col(column))


def outlier_to_null(column: str, other: str, factor: float) -> Column:
    """NULL where the column is more than `factor` times its companion."""
    return F.when(F.col(column) > factor * zero(other), None).otherwise(F.col(column))


def null_block_flag(columns: Iterable[str]) -> Column:
    """1 where every column of the block is NULL."""
    return F.when(reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns]), 1).otherwise(0)


def bonus_month(period: int, amount: str, counter: str, jump: float = 1.3) -> Column:
    """Evidence of an extra pay-in in `period`: two or more pay-ins, or a jump against the row before."""
    before = F.lag(amount, 1).over(history())
    return (F.col(K.PERIOD) == period) & ((F.col(counter) >= 2) | (F.col(amount) > jump * before))


def without_bonus(column: str, evidence: Column, is_counter: bool, factor: float = 1.5) -> Column:
    if is_counter:
        return F.when(evidence & (F.col(column) >= 2), F.col(column) - 1).otherwise(F.col(column))
    return F.when(evidence, F.col(column) / factor).otherwise(F.col(column))


def carried(column: str, period: int) -> Column:
    """The row before's value in a bad period, the own value where there is no row before."""
    before = F.lag(column, 1).over(history())
    return F.when(F.col(K.PERIOD) == period, F.coalesce(before, F.col(column))).otherwise(F.col(column))


def zero_where_injected(column: str, companion: str, periods: Sequence[int] | None = None) -> Column:
    """0 where the companion column is 0, the mark of injected rows."""
    injected = F.col(companion) == 0
    if periods is not None:
        injected = injected & F.col(K.PERIOD).isin(*periods)
    return F.when(injected, 0).otherwise(F.col(column))


def _without(panel: DataFrame, names: Iterable[str]) -> DataFrame:
    """The panel without the columns and without what was derived from them."""
    stale = {f"{c}{s}" for c in names for s in ("", "__lag1", "__delta1", "__lag2", "__delta2")}
    return panel.drop(*[c for c in panel.columns if c in stale])


def repaired_in_place(panel: DataFrame, repairs: Mapping[str, Column]) -> DataFrame:
    """Swap columns for repaired ones computed from the same rows: no join."""
    fresh = panel.withColumns({f"_r_{c}": e for c, e in repairs.items()})
    return _without(fresh, repairs).withColumnsRenamed({f"_r_{c}": c for c in repairs})


def replace_columns(panel: DataFrame, repaired: DataFrame) -> DataFrame:
    """Swap columns of a stored panel for the same-named ones of another table, by key."""
    names = [c for c in repaired.columns if c not in (K.ENTITY, K.PERIOD)]
    return _without(panel, names).join(repaired, [K.ENTITY, K.PERIOD])
