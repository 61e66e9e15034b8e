"""Exact quantiles of many columns by selection: fold all values around the wanted place, then order only those close to it.

A first scan sketches, per period and column, two points close below and above the wanted place. A second folds the values in Arrow batches:
one count for all below, one for all above, and one per distinct value between the points, a few in a thousand of them. Only these counts are
shuffled and put in order. If they show that a pair of points misses the place, all values of that period and column are ordered: the
result is exact whatever the sketch says. NULL is no value; NaN is the largest one. A period without values has no row. NULL periods form
a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions import keys as K
from panelmill.operators.ordered import group_quantiles, running_sums
from panelmill.session import BROADCAST_BYTES, broadcast_if_small, checkpoint

P = K.PERIOD

#: Share of the values on each side of the wanted place that the points leave room for, and the sketch's accuracy: its error is a quarter of that.
MARGIN, ACCURACY = 0.002, 2_000


def as_double(column: str) -> Column:
    return F.col(column).cast("double")


def counts_around(rows: DataFrame, values: Sequence[Column], share: float) -> DataFrame:
    """(period, i, side, value, ties): how many values lie below (-1) and above (1) the points, and each distinct value between them (0)."""
    around = [max(0.0, share - MARGIN), min(1.0, share + MARGIN)]
    sketches = F.array(*[F.percentile_approx(F.when(~F.isnan(v), v), around, ACCURACY) for v in values])
    near = checkpoint(rows.groupBy(F.col(P).alias("_period")).agg(sketches.alias("_points")))
    # one small row per period; past the bound periods are many, and the join shuffles by period
    met = _told_in_batches(rows, values, near) if near.count() * 32 * len(values) <= BROADCAST_BYTES else _told_by_join(rows, values, near)
    return met.groupBy(P, "i", "side", "value").agg(F.sum("ties").alias("ties"))


def _told_in_batches(rows: DataFrame, values: Sequence[Column], near: DataFrame) -> DataFrame:
    """The counts of each Arrow batch: of a period and column one row for all below, one for all above, one per distinct value between."""
    own = {r["_period"]: [(np.nan, np.nan) if p is None else tuple(p) for p in r["_points"]] for r in near.collect()}
    shared = rows.sparkSession.sparkContext.broadcast(own)
    period = rows.schema[P].dataType
    held = rows.select(P, *[v.alias(f"_v{i}") for i, v in enumerate(values)])

    def told(i: int, cells: pa.Array, low: float, high: float) -> tuple[np.ndarray, ...]:
        """(i, side, value, whether it has one, ties) of one column's cells; without points, which only NaN has none of, all are between."""
        x = cells.drop_null().to_numpy(zero_copy_only=False)
        # NaN is the largest value: above the points where there are any
        below, between = x < low, ~((x < low) | (x > high) | (np.isnan(x) & ~np.isnan(high)))
        distinct, ties = np.unique(x[between] + 0.0, return_counts=True)
        n_below, n_between = np.count_nonzero(below), np.count_nonzero(between)
        sides = [(-1, n_below), (1, len(x) - n_below - n_between)]
        ends = [(s, n) for s, n in sides if n]
        side = np.r_[[s for s, _ in ends], np.zeros(len(distinct))].astype(np.int32)
        value = np.r_[np.zeros(len(ends)), distinct]
        return np.full(len(side), i, np.int32), side, value, side == 0, np.r_[[n for _, n in ends], ties].astype(np.int64)

    def fold(batches):
        for batch in batches:
            kinds = batch.column(0).dictionary_encode()
            which = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for at, key in [(-1, None), *enumerate(kinds.dictionary.to_pylist())]:
                chosen = np.flatnonzero(which == at)
                parts = [told(i, c.take(pa.array(chosen)), *shared.value[key][i]) for i, c in enumerate(batch.columns[1:])] if len(chosen) else []
                if parts:
                    i, side, value, known, ties = (np.concatenate(c) for c in zip(*parts))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key] * len(i), batch.schema.types[0]), pa.array(i, pa.int32()), pa.array(side, pa.int32()),
                        pa.array(value, pa.float64(), mask=~known), pa.array(ties, pa.int64()),
                    ], [P, "i", "side", "value", "ties"])

    schema = T.StructType([T.StructField(P, period), *T.StructType.fromDDL("i int, side int, value double, ties long")])
    return held.mapInArrow(fold, schema)


def _told_by_join(rows: DataFrame, values: Sequence[Column], near: DataFrame) -> DataFrame:
    """The same with the points joined to the rows, one row per value."""
    def told(i: int, v: Column) -> Column:
        points = F.get("_points", F.lit(i))
        side = F.when(v < F.get(points, F.lit(0)), -1).when(v > F.get(points, F.lit(1)), 1).otherwise(0)
        return F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), side.alias("side"), F.when(side == 0, v).alias("value")))

    each = F.array(*[told(i, v) for i, v in enumerate(values)])
    met = rows.join(near, F.col(P).eqNullSafe(F.col("_period"))).select(P, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x"))
    return met.select(P, "x.*", F.lit(1).cast("long").alias("ties"))


def selected_quantile(panel: DataFrame, columns: Sequence[str], share: float, name: str, value: Callable[[str], Column] = as_double) -> DataFrame:
    """(period, feature, name): the exact, linearly interpolated quantile of each column in each period."""
    rows = checkpoint(panel.select(P, *dict.fromkeys(columns)))  # two scans read it
    values = [value(c) for c in columns]
    names = F.array(*[F.lit(c) for c in columns])
    order = [F.col("side"), F.col("value")]
    placed = running_sums(counts_around(rows, values, share), [P, "i"], order, order, {"_upto": F.col("ties")})
    at = F.lit(share) * (F.col("_upto_total") - 1)

    def holds(place: Column) -> Column:
        return (F.col("side") == 0) & (F.col("_upto") - F.col("ties") <= place) & (place < F.col("_upto"))

    ends = {"_lo": F.floor(at), "_hi": F.ceil(at)}
    found = checkpoint(placed.groupBy(P, "i").agg(
        *[F.max(F.when(holds(k), F.col("value"))).alias(n) for n, k in ends.items()], F.max(at - F.floor(at)).alias("_w"),
    ))
    sure = found.filter("_lo is not null and _hi is not null").select(
        P, F.get(names, "i").alias("feature"), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias(name))
    missed = found.filter("_lo is null or _hi is null").select(F.col(P).alias("_period"), F.col("i").alias("_i"))
    if missed.isEmpty():
        return sure
    each = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("value")) for i, v in enumerate(values)])
    long = rows.select(P, F.explode(each).alias("x")).select(P, "x.*").filter("value is not null")
    rest = long.join(broadcast_if_small(missed), F.col(P).eqNullSafe(F.col("_period")) & (F.col("i") == F.col("_i")), "left_semi")
    exact = group_quantiles(rest, [P, "i"], "value", {name: share})
    return sure.unionByName(exact.select(P, F.get(names, "i").alias("feature"), name))
