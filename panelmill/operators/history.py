"""History features over an entity's own rows.

All of them use windows partitioned by entity, whose groups are at most as long as the
number of periods. Functions return `{column name: expression}` so that many of
them share one exchange and one sort in a single `withColumns`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.period import periods_between
from panelmill.functions.scalars import flag, ratio, safe_ratio, signed_growth, sure_flag, zero

Features = dict[str, Column]


def history(entity: str = K.ENTITY, order: str = K.PERIOD) -> WindowSpec:
    """An entity's rows up to the current one."""
    return Window.partitionBy(entity).orderBy(order)


def last_rows(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return history().rowsBetween(-(n - 1), 0)


def previous_rows(n: int) -> WindowSpec:
    """The n rows before the current one."""
    return history().rowsBetween(-n, -1)


def all_rows() -> WindowSpec:
    return history().rowsBetween(Window.unboundedPreceding, 0)


def lags(columns: Iterable[str], n: int = 1, cast: str | None = None) -> Features:
    """The value n present rows ago; a gap makes it older than n months."""
    h = history()
    out = {f"{c}__lag{n}": F.lag(c, n).over(h) for c in columns}
    return {k: v.cast(cast) for k, v in out.items()} if cast else out


def calendar_lags(columns: Iterable[str], n: int = 1) -> Features:
    """The value exactly n months ago; NULL where that month is missing."""
    h = history()
    gap = periods_between(F.lag(K.PERIOD, 1).over(h), F.col(K.PERIOD))
    if n == 1:
        return {f"{c}__mes1": F.when(gap == 1, F.lag(c, 1).over(h)) for c in columns}
    back = [(F.lag(K.PERIOD, i).over(h), i) for i in range(1, n + 1)]
    out = {}
    for c in columns:
        value = F.lit(None)
        for period, i in back:
            value = F.when(periods_between(period, F.col(K.PERIOD)) == n, F.lag(c, i).over(h)).otherwise(value)
        out[f"{c}__mes{n}"] = value
    return out


def deltas(columns: Iterable[str], n: int = 1, cast: str | None = None) -> Features:
    h = history()
    out = {f"{c}__delta{n}": F.col(c) - F.lag(c, n).over(h) for c in columns}
    return {k: v.cast(cast) for k, v in out.items()} if cast else out


def lag_block(columns: Sequence[str], cast: str = "float") -> Features:
    """lag1, delta1, lag2, delta2 of every column, narrowed to 4-byte floats."""
    h, out = history(), {}
    for c in columns:
        now = F.col(c)
        for n in (1, 2):
            before = F.lag(now, n).over(h)
            out[f"{c}__lag{n}"] = before.cast(cast)
            out[f"{c}__delta{n}"] = (now - before).cast(cast)
    return out


# The moving aggregates by name.
MOVING = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "stddev": F.stddev}


def moving(columns: Iterable[str], functions: Sequence[str] = ("avg", "min", "max"), window: WindowSpec | None = None) -> Features:
    window = window if window is not None else all_rows()
    return {f"{c}__{f}": MOVING[f](c).over(window) for c in columns for f in functions}


def slopes(columns: Iterable[str], axis: str = "cliente_antiguedad", window: WindowSpec | None = None, suffix: str = "slope") -> Features:
    """Least-squares slope against the axis; NULL on one point or a constant axis."""
    window = window if window is not None else all_rows()
    return {f"{c}__{suffix}": F.regr_slope(c, axis).over(window) for c in columns}


def running_count(condition: Column) -> Column:
    """Rows so far on which the condition held; unknown rows are not counted."""
    return F.sum(flag(condition)).over(all_rows())


def transitions(columns: Iterable[str]) -> Features:
    h, out = history(), {}
    for c in columns:
        now, before = zero(c), F.lag(c, 1).over(h)
        out[f"{c}__a_cero"] = ((now == 0) & (before > 0)).cast("byte")
        out[f"{c}__a_negativo"] = ((now < 0) & (before >= 0)).cast("byte")
        out[f"{c}__desde_cero"] = ((now > 0) & (before == 0)).cast("byte")
    return out


def recency(condition: Column, horizon: int = 3) -> Column:
    """Rows since the event: 0 = this row, at most `horizon` (also when it never was seen)."""
    seen = sure_flag(condition)
    out = F.when(seen == 1, 0)
    for n in range(1, horizon):
        out = out.when(F.lag(seen, n).over(history()) == 1, n)
    return out.otherwise(horizon).cast("byte")


def streak(condition_column: str, longest: int = 4) -> Column:
    """Consecutive rows back, current one included, on which a 0 / 1 column is 1."""
    held = F.lit(longest)
    for n in range(longest - 1, -1, -1):
        past = F.col(condition_column) if n == 0 else F.lag(condition_column, n).over(history())
        held = F.when(past == 1, held).otherwise(n)
    return held.cast("byte")


def open_streak(panel: DataFrame, condition_column: str, name: str) -> DataFrame:
    """Streak without an upper bound: rows since the last row on which the column was not 1."""
    broken = F.max(F.when(F.col(condition_column) == 1, F.lit(0)).otherwise(F.col("_row"))).over(all_rows())
    return (
        panel.withColumn("_row", F.row_number().over(history()))
        .withColumn(name, F.col("_row") - broken)
        .drop("_row")
    )


def growth(columns: Iterable[str]) -> Features:
    return {f"{c}__crec1": signed_growth(F.col(c), F.lag(c, 1).over(history())) for c in columns}


def onset(now: Column, before: Callable[[WindowSpec], Column]) -> Column:
    """1 on the row where a state starts; NULL on the first row, which has no history."""
    h = history()
    return F.when(F.row_number().over(h) > 1, flag(now & before(h)))


def own_history(columns: Sequence[str]) -> Features:
    """Ratio to own mean and maximum, acceleration and relative volatility, from three previous rows."""
    past, h = previous_rows(3), history()
    out: Features = {}
    for c in columns:
        mean, l1, l2 = F.avg(c).over(past), F.lag(c, 1).over(h), F.lag(c, 2).over(h)
        out[f"{c}__vs_propio"] = safe_ratio(c, mean)
        out[f"{c}__acel"] = (F.col(c) - l1) - (l1 - l2)
        out[f"{c}__volrel"] = safe_ratio(F.stddev(c).over(past), mean)
        out[f"{c}__vs_max"] = safe_ratio(c, F.max(c).over(past))
    return out


def previous_statistics(columns: Sequence[str], n: int = 3) -> Features:
    past = previous_rows(n)
    names = {"avg": "avg", "sd": "stddev", "min": "min", "max": "max"}
    return {f"{c}__{k}{n}": MOVING[f](c).over(past) for c in columns for k, f in names.items()}


def loss_features(panel: DataFrame, column: str = "cproductos", prefix: str = "p_") -> DataFrame:
    """How much of a counter was lost: last change, against 3-row minimum and maximum, losses added up."""
    three = last_rows(3)
    before, now = F.coalesce(F.col("_before"), F.col(column)), F.col(column)
    return (
        panel.withColumn("_before", F.lag(column, 1).over(history()))
        .withColumns({
            f"{prefix}delta": now - F.col("_before"),
            f"{prefix}vs_min3": now - F.min(column).over(three),
            f"{prefix}caida_desde_max3": F.max(column).over(three) - now,
            f"{prefix}perdidos_3m": F.sum(F.greatest(F.lit(0), before - now)).over(three),
            f"{prefix}perdio": flag(now < before),
        })
        .drop("_before")
    )


def minimal_history(columns: Iterable[str]) -> Features:
    """lag1, delta1, mean of the two previous rows, ratio to it."""
    out: Features = {}
    for c in columns:
        mean = F.avg(c).over(previous_rows(2))
        out |= lags([c]) | deltas([c])
        out[f"{c}__media2"] = mean
        out[f"{c}__vs_media2"] = ratio(c, mean)
    return out


def history_depth() -> Features:
    """How many earlier rows the history features of a row could look at."""
    return {"n_historia": F.row_number().over(history()) - 1}


def add(panel: DataFrame, *features: Mapping[str, Column]) -> DataFrame:
    """One `withColumns` for all features, so they share the window's exchange and sort."""
    return panel.withColumns({k: v for f in features for k, v in f.items()})
