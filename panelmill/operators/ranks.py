"""Ranks within a period and deflators, for many columns at once.

Values that many rows share, and NULLs, stay where they are: their ranks follow from counts, which are folded map-side and come back as one
broadcast row per period, joined when the rows are in place. Only the other cells are turned into long form, shuffled and ranked, block by block (see `ordered`), and
pivoted back. Neither a period nor a frequent value is ever handled by one task alone, and the path is the same at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.scalars import safe_ratio
from panelmill.operators.ordered import (
    RANK_FUNCTIONS,
    ntile_of,
    row_numbers,
    unpivot,
    with_value_ranks,
)
from panelmill.operators.selection import selected_quantile
from panelmill.session import broadcast_if_small, checkpoint, staged

E, P = K.ENTITY, K.PERIOD

def _widen(long: DataFrame, features: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """(entity, period, feature, v...) -> one row per (entity, period).

    Hashed on the entity alone, so that windows over the entity need no further shuffle.
    """
    wide = (
        long.repartition(F.col(E))
        .groupBy(E, P)
        .pivot("feature", list(features))
        .agg(*[F.max(v).alias(v) for v in values])
    )
    single = len(values) == 1
    return wide.select(
        E, P,
        *[
            F.col(f if single else f"{f}_{v}").alias(name.format(f))
            for f in features
            for v, name in values.items()
        ],
    )


#: Equal parts that a column's period is cut into, at least; a value that fills two of the points between them is frequent.
PARTS = 64
#: Most bytes of the points and counts of all columns and periods, which are broadcast: with more of them, there are fewer parts.
FACTS_BYTES = 32 << 20


def _by_column(columns: Sequence[str], prefix: str) -> dict[str, str]:
    """A name for each column that is free of the column's own."""
    return {c: f"_{prefix}_{i}" for i, c in enumerate(columns)}


def _points(panel: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, int]:
    """One row per period with the points between equal parts of each column, found in wide form: no cell is shuffled for them.

    As many parts as the session shuffles into, so that one of a large period fits a task; thinned out until points and counts of all fit.
    """
    names = _by_column(columns, "p")
    parts = max(PARTS, min(1000, int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / parts for i in range(1, parts)]
    known = {n: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c, n in names.items()}
    points = panel.groupBy(F.col(P).alias("_period")).agg(*[F.percentile_approx(x, shares, 20 * parts).alias(n) for n, x in known.items()])
    points = checkpoint(points.select("_period", *[F.coalesce(n, F.array().cast("array<double>")).alias(n) for n in names.values()]))
    step = max(1, -(-points.count() * len(columns) * parts * 40 // FACTS_BYTES))
    if step > 1:
        points = points.withColumns({n: F.filter(n, lambda _, i: i % step == step - 1) for n in names.values()})
    return F.broadcast(points), parts


def coded(panel: DataFrame, columns: Sequence[str], points: DataFrame, parts: int) -> DataFrame:
    """The panel with a code for each column that never decreases along its values in a period.

    With b of the period's points below a value, its code is 2 b, or 2 b + 1 if it is frequent; NULL has -1.
    """
    names, codes = _by_column(columns, "p"), _by_column(columns, "k")
    # one row per period, FACTS_BYTES in all: looked up in the tasks, where a row that carried its period's points would be long
    own = {r["_period"]: [np.array(r[n], float) for n in names.values()] for r in points.collect()}
    shared = panel.sparkSession.sparkContext.broadcast(own)

    @F.arrow_udf("array<int>")
    def code(period: pa.Array, *values: pa.Array) -> pa.Array:
        out = np.empty((len(period), len(values)), np.int32)
        kinds = period.dictionary_encode()
        which = np.where(period.is_null().to_numpy(zero_copy_only=False), -1, kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False))
        for at, key in [(-1, None), *enumerate(kinds.dictionary.to_pylist())]:
            rows = np.flatnonzero(which == at)
            for i, v in enumerate(values if len(rows) else ()):
                edges, x = shared.value[key][i], v.to_numpy(zero_copy_only=False)[rows]
                below = np.searchsorted(edges, x)
                ends = np.r_[edges, np.nan, np.nan]
                out[rows, i] = 2 * below + ((ends[below] == x) & (ends[np.minimum(below + 1, len(ends) - 1)] == x))
        for i, v in enumerate(values):
            out[v.is_null().to_numpy(zero_copy_only=False), i] = -1
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, len(values), dtype=np.int32), pa.array(out.ravel()))

    told = panel.withColumn("_codes", code(F.col(P), *[F.col(c).cast("double") for c in columns]))
    return told.select(*panel.columns, *[F.get("_codes", i).alias(codes[c]) for i, c in enumerate(columns)])


def _cells(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., place, value, code) of each cell; place is the column's in `columns`."""
    codes = _by_column(columns, "k")
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).cast("double").alias("value"), F.col(codes[c]).alias("code")) for i, c in enumerate(columns)])
    return rows.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.*")


def _counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(period, place, code, rows, less): cells of that code, and cells with values of smaller codes.

    Cells are counted by code, folded map-side; only counts are shuffled.
    """
    counts = _cells(rows, columns, [P]).groupBy(P, "place", "code").agg(F.count(F.lit(1)).alias("rows"))
    one = Window.partitionBy(P, "place")
    below = F.sum(F.when(F.col("code") >= 0, F.col("rows"))).over(one.orderBy("code").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("less", F.coalesce(below, F.lit(0)))


def _facts(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per period: of each column struct(n, nulls, frequent), the last a map from the codes of frequent values to (less, rows)."""
    frequent = F.when((F.col("code") >= 0) & (F.col("code") % 2 == 1), F.struct("code", F.struct("less", "rows")))
    facts = counts.groupBy(P, "place").agg(F.struct(
        F.sum("rows").alias("n"), F.coalesce(F.sum(F.when(F.col("code") < 0, F.col("rows"))), F.lit(0)).alias("nulls"),
        F.map_from_entries(F.collect_list(frequent)).alias("frequent"),
    ).alias("f"))
    wide = facts.groupBy(F.col(P).alias("_period")).pivot("place", list(range(len(columns)))).agg(F.first("f"))
    return wide.select("_period", *[F.col(str(i)).alias(n) for i, n in enumerate(_by_column(columns, "f").values())])


def rare_cells(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(entity, period, place, value, code, feature) of the cells that are neither NULL nor frequent: all that is shuffled to be ranked."""
    rare = _cells(rows, columns, [E, P]).filter((F.col("code") >= 0) & (F.col("code") % 2 == 0))
    return rare.withColumn("feature", F.get(F.array(*[F.lit(c) for c in columns]), "place"))


def _placed_rare(rows: DataFrame, columns: Sequence[str], counts: DataFrame, ties: bool) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """One row per (_entity, _month) with the places of its rare cells, and the names of these columns.

    Cells go to their block and back to their row, as numbers alone; a row's cells are gathered by one aggregate.
    """
    part = Window.partitionBy(P, "place", "code")
    # longs, which are folded by hash; ties only where a function asks for them
    local = {"less": F.rank().over(part.orderBy("value")).cast("long") - 1}
    if ties:
        local["ties"] = F.count(F.lit(1)).over(Window.partitionBy(P, "place", "code", "value"))
    cells = rare_cells(rows, columns).drop("feature").withColumns(local)
    base = counts.select(F.col(P).alias("_period"), F.col("place").alias("_i"), F.col("code").alias("_code"), F.col("less").alias("_base"))
    same = F.col(P).eqNullSafe(F.col("_period")) & (F.col("place") == F.col("_i")) & (F.col("code") == F.col("_code"))
    ranked = cells.join(F.broadcast(base), same).withColumn("less", F.col("less") + F.col("_base"))
    names = {v: _by_column(columns, v) for v in local}
    own = [F.max(F.when(F.col("place") == i, F.col(v))).alias(names[v][c]) for v in local for i, c in enumerate(columns)]
    back = ranked.select(F.col(E).alias("_entity"), F.col(P).alias("_month"), "place", *local)
    return back.groupBy("_entity", "_month").agg(*own), names


def period_ranks(
    panel: DataFrame,
    columns: Sequence[str],
    functions: Sequence[str] = ("percent_rank",),
    nulls: str = "last",
    replace: bool = False,
) -> DataFrame:
    """Rank of each column within its period, as `<column>__<function>`.

    `nulls`: "last" ranks NULLs together after all values; "keep" leaves them NULL, though
    they still count in the number of rows. With `replace`, the rank takes the column's place.
    """
    name = "{}" if replace else "{}__{}"
    if "dense_rank" in functions:  # counts the distinct values below, so every value has to meet its like
        return _dense_ranks(panel, columns, functions, nulls, replace, name)
    rows = staged(coded(panel, columns, *_points(panel, columns)))  # counts, rare cells and the result all read it
    counts = checkpoint(_counts(rows, columns))
    codes, facts = (_by_column(columns, p) for p in ("k", "f"))
    rare, places = _placed_rare(rows, columns, counts, ties=bool(set(functions) - {"percent_rank", "rank"}))
    # the facts come last: joined before, every row would carry them through the shuffle
    joined = rows.join(rare, F.col(E).eqNullSafe(F.col("_entity")) & F.col(P).eqNullSafe(F.col("_month")), "left").join(
        F.broadcast(checkpoint(_facts(counts, columns))), F.col(P).eqNullSafe(F.col("_period"))
    )

    def placed(c: str) -> Column:
        code, f = F.col(codes[c]), F.col(facts[c])
        own = {v: F.col(names[c]) for v, names in places.items()}
        null, frequent = code < 0, code % 2 == 1
        at = F.try_element_at(f["frequent"], code)
        less = F.when(null, f["n"] - f["nulls"]).when(frequent, at["less"]).otherwise(own["less"])
        ties = F.when(null, f["nulls"]).when(frequent, at["rows"]).otherwise(own.get("ties", F.lit(None).cast("long")))
        return F.struct(less.cast("long").alias("less"), ties.alias("ties"), f["n"].alias("n"), F.lit(None).cast("long").alias("level"))

    filled = joined.withColumns({f"_at_{i}": placed(c) for i, c in enumerate(columns)})
    kept = [c for c in panel.columns if not (replace and c in columns)]
    known = lambda c: F.lit(nulls != "keep") | (F.col(codes[c]) >= 0)
    ranks = [F.when(known(c), RANK_FUNCTIONS[f](f"_at_{i}.")).alias(name.format(c, f)) for i, c in enumerate(columns) for f in functions]
    return filled.select(*kept, *ranks)


def _dense_ranks(panel: DataFrame, columns: Sequence[str], functions: Sequence[str], nulls: str, replace: bool, name: str) -> DataFrame:
    long = with_value_ranks(unpivot(panel, [E, P], columns), [P, "feature"], "value", {f"_rank_{f}": f for f in functions})
    if nulls == "keep":
        long = long.withColumns({f"_rank_{f}": F.when(F.col("value").isNotNull(), F.col(f"_rank_{f}")) for f in functions})
    wide = _widen(long, columns, {f"_rank_{f}": name.format("{}", f) for f in functions})
    kept = panel.drop(*columns) if replace else panel
    return kept.join(wide, [E, P])


def zero_fixed_ranks(panel: DataFrame, columns: Sequence[str], suffix: str = "rank_cero_fijo") -> DataFrame:
    """Signed rank within the period: positives and negatives apart, zero stays 0.

    The rank is the value's cumulative share on its own side of zero, so it lies in [-1, 1].
    """
    long = unpivot(panel, [E, P], columns, keep_nulls=False).withColumn(
        "signo", F.signum("value").cast("int")
    )
    sized = long.withColumn("tamano", F.abs("value"))
    ranked = with_value_ranks(sized, [P, "feature", "signo"], "tamano", {"_cume": "cume_dist"}).withColumn(
        "_r", F.col("_cume") * F.col("signo")
    )
    return panel.join(_widen(ranked, columns, {"_r": "{}__" + suffix}), [E, P], "left")


def period_ntiles(panel: DataFrame, column: str, tiles: Sequence[int] = (4, 10)) -> DataFrame:
    """ntile within the period, ties broken by entity: one distributed numbering for all k."""
    numbered = row_numbers(
        panel, [P], [F.col(column).asc_nulls_last(), F.col(E).asc()], [F.col(column), F.col(E)], "_rn", "_n"
    )
    return numbered.withColumns(
        {f"{column}__ntile_{k}": ntile_of(k, F.col("_rn"), F.col("_n")) for k in tiles}
    ).drop("_rn", "_n")


def expression_rank(panel: DataFrame, name: str, value, nulls: str = "last") -> DataFrame:
    """percent_rank within the period of a computed value."""
    return period_ranks(panel.withColumn(name, value), [name], nulls=nulls, replace=True)


def period_medians(panel: DataFrame, columns: Sequence[str], positive: bool = True) -> DataFrame:
    """(period, feature, mediana): exact median of positive values, or of |x| where x <> 0, found by selection."""
    number = lambda c: F.col(c).cast("double")
    value = (lambda c: F.when(number(c) > 0, number(c))) if positive else (lambda c: F.when(number(c) != 0, F.abs(number(c))))
    return selected_quantile(panel, columns, 0.5, "mediana", value)


def wide_medians(panel: DataFrame, columns: Sequence[str], positive: bool = True, name: str = "{}") -> DataFrame:
    """One row per period with a median per column; periods without any value have no row."""
    return period_medians(panel, columns, positive).groupBy(P).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("mediana"))).alias(name.format(c)) for c in columns]
    )


def with_medians(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach the period's medians as `<column>__d` by a join on the period."""
    medians = broadcast_if_small(wide_medians(panel, columns, name="{}__d"))
    return panel.join(medians, P, "left")


def deflate(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add `<column>__defl`: the amount over the median of its positive values in the period."""
    joined = with_medians(panel, columns)
    return joined.withColumns({f"{c}__defl": safe_ratio(c, f"{c}__d") for c in columns}).drop(
        *[f"{c}__d" for c in columns]
    )


def price_index(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(period, feature, mediana, indice): median of |x| where x <> 0, first period = 100."""
    medians = broadcast_if_small(period_medians(panel, columns, positive=False))
    first = medians.groupBy(F.col("feature").alias("_f")).agg(F.min_by("mediana", P).alias("_base"))
    return medians.join(first, F.col("feature") == F.col("_f")).select(
        P, "feature", "mediana",
        (F.try_divide(F.col("mediana"), F.col("_base")) * 100).alias("indice"),
    )
