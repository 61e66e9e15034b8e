"""Ranks, running sums and quantiles of large groups, without one task per group.

A window over a period, a model or a whole table sends that group to a single task. Here a group is cut into
blocks at approximate quantiles of its order: the block of a row is a function of the row and its group's split
points alone, so rows are shuffled once, by (group, block). Blocks are summed on the small block table and a
window inside each block does the rest. A value that fills many quantiles has blocks of its own, cut again by
the second sort key (or, for ranks, by a hash), and so do nulls: a value that a third of the rows share is
spread like any other. Groups compare null-safe: rows whose group is NULL form a group.

The input is checkpointed once, because split points, block table and windows all read it. Rows are then
shuffled once, by the struct of their group and block: windows, block sums and the join of the two use that one key.

Split points are always broadcast, so no row is ever shuffled by its group alone. They are bounded by `SPLIT_BYTES`: with more groups,
each has fewer of them, as the groups then spread the work themselves. Beyond one split point a group, where even that would pass the
bound, a group is a single block: there are then over SPLIT_BYTES / 32 of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import checkpoint

_KEY, _ONE, _TWO = "_key", "_block_1", "_block_2"
#: Most bytes of all split points, which are broadcast.
SPLIT_BYTES = 32 << 20


def same_group(group: Sequence[str], prefix: str = "_g_") -> Column:
    """Null-safe equality of the group columns with their prefixed copies."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in group], F.lit(True))


def _blocks(spark) -> int:
    """Blocks that a group which is the whole table is to have: as many as the session shuffles into."""
    return max(2, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _fitting(points: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The split points of all groups thinned out until they fit SPLIT_BYTES, and how many blocks that leaves a group."""
    small = checkpoint(points)
    step = -(-small.count() * 2 * n * 8 // SPLIT_BYTES)
    if step <= 1:
        return small, n
    thin = lambda c: F.filter(c, lambda x, i: i % step == step - 1)
    return small.withColumns({"_p1": thin(F.col("_p1")), "_p2": thin(F.col("_p2"))}), (n - 1) // step + 1


def _below(points: Column, x: Column, steps: int) -> Column:
    """How many of the ascending points are less than x, by halving steps."""
    widths = F.array(*[F.lit(1 << i) for i in reversed(range(steps.bit_length()))])

    def go(at: Column, width: Column) -> Column:
        on = at + width
        return F.when((on <= F.size(points)) & (F.get(points, on - 1) < x), on).otherwise(at)

    return F.aggregate(widths, F.lit(0), go)


def _in_blocks(df: DataFrame, group: Sequence[str], first: Column, second: Column | None) -> DataFrame:
    """The rows with `_key`, the struct of their group and two block numbers.

    `first` never decreases along the order (NULL last), `second` never along equal `first`; without it equal
    rows are spread by hash. Block 1 is odd if it holds a single value of `first` (or its NULLs), even otherwise.
    """
    if not group:
        return _in_blocks(df.withColumn("_whole", F.lit(0)), ["_whole"], first, second).drop("_whole")
    n = _blocks(df.sparkSession)
    shares = [i / n for i in range(1, n)]
    keyed = checkpoint(df).withColumns({"_first": first.cast("double"), "_second": (F.xxhash64(*df.columns) if second is None else second).cast("double")})
    known = F.when(~F.isnan("_first"), F.col("_first"))
    points = keyed.groupBy(*group).agg(
        F.percentile_approx(known, shares, 20 * n).alias("_p1"),
        F.percentile_approx("_second", shares, 20 * n).alias("_p2"),
        F.count(F.lit(1)).alias("_rows"), F.count("_first").alias("_known"),
    ).select(*[F.col(c).alias(f"_g_{c}") for c in group], "_p1", "_p2", "_rows", "_known")
    points, n = _fitting(points, n)
    if n == 1:  # a block each: nothing to look up
        return keyed.withColumn(_KEY, F.struct(*group, F.col("_first").isNull().cast("int").alias(_ONE), F.lit(0).alias(_TWO))).select(*df.columns, _KEY)
    split = keyed.join(F.broadcast(points), same_group(group))
    p1, p2, x = F.coalesce("_p1", F.array().cast("array<double>")), F.coalesce("_p2", F.array().cast("array<double>")), F.col("_first")
    below = _below(p1, x, n)
    alone = x.isNull() | F.coalesce(F.get(p1, below) == x, F.lit(False))
    at = F.when(x.isNull(), 2 * F.size(p1) + 1).otherwise(2 * below + alone.cast("int"))
    # parts of a single value: the quantiles it fills, or the share of rows that are NULL
    parts = F.when(x.isNull(), F.ceil((F.col("_rows") - F.col("_known")) / F.col("_rows") * n)).otherwise(
        F.size(F.filter(p1, lambda q: q == x))
    )
    place = _below(p2, F.col("_second"), n)  # 0 .. n - 1, each about 1 / n of the rows
    two = F.when(alone & (parts > 1), F.floor(place * parts / n)).otherwise(0).cast("int")
    key = F.struct(*group, at.alias(_ONE), two.alias(_TWO))
    return split.withColumn(_KEY, key).select(*df.columns, _KEY)


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    along: Sequence[Column],
    sums: Mapping[str, Column],
    totals: bool = True,
) -> DataFrame:
    """Add, per group, the running sum of each expression up to and including the row.

    `order` must be a total order inside the group; `along` holds one or two numeric expressions that never
    decrease along it (NULL last): for `score` descending, then entity, `[-score, entity]`. For every name in
    `sums` the result has `name` and, with `totals`, `name_total`, the sum over the whole group.
    """
    names = list(sums)
    second = along[1] if len(along) > 1 else F.lit(0)
    rows = _in_blocks(df.withColumns({f"_v_{n}": sums[n] for n in names}), group, along[0], second)
    per_block = rows.groupBy(_KEY).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    whole = Window.partitionBy(*[F.col(f"{_KEY}.{c}") for c in group])
    before = whole.orderBy(f"{_KEY}.{_ONE}", f"{_KEY}.{_TWO}").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        F.col(_KEY).alias("_block"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names],
        *([F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in names] if totals else []),
    )
    inside = Window.partitionBy(_KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    return local.join(offsets, F.col(_KEY) == F.col("_block")).withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in names}).drop(
        _KEY, "_block", *[f"_{k}_{n}" for k in "vol" for n in names]
    )


def row_numbers(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], along: Sequence[Column], name: str = "rn", total: str = "n"
) -> DataFrame:
    """Position of each row in its group under a total order, and the group's row count."""
    ones = F.lit(1).cast("long")
    return running_sums(df, group, order, along, {name: ones}).withColumnRenamed(f"{name}_total", total)


def ntile_of(k: int, rn: Column, n: Column) -> Column:
    """SQL ntile(k) from a row number and a row count: the first n % k tiles get one more."""
    size, extra = F.floor(n / k), n % k
    edge = extra * (size + 1)
    return (
        F.when(rn <= edge, F.floor((rn - 1) / (size + 1)) + 1)
        .otherwise(extra + F.floor(F.try_divide(rn - 1 - edge, size)) + 1)
        .cast("int")
    )


def value_positions(
    df: DataFrame,
    group: Sequence[str],
    value: str = "value",
    sums: Mapping[str, Column] | None = None,
    ties: str | None = None,
) -> DataFrame:
    """One row per (group, value): its copies and where they sit in the group's order. `ties` names a column of copies, if rows are counted already.

    `ties` rows hold the value, `less` rows are strictly below (NULL sorts last), `n` rows are
    in the group, `level` is the dense rank. Extra `sums` are added up per value and run
    along (`x`, `x_upto`, `x_total`). Equal values collapse before the shuffle, so a value
    that fills a third of the table is one row here.
    """
    sums = dict(sums or {})
    counts = df.groupBy(*group, value).agg(
        (F.count(F.lit(1)) if ties is None else F.sum(ties)).alias("ties"), *[e.alias(n) for n, e in sums.items()]
    )
    run = running_sums(
        counts,
        group,
        [F.col(value).asc_nulls_last()],
        [F.col(value)],
        {"_upto": F.col("ties"), "level": F.lit(1).cast("long"), **{f"{n}_upto": F.col(n) for n in sums}},
    )
    return run.select(
        *group,
        value,
        "ties",
        (F.col("_upto") - F.col("ties")).alias("less"),
        F.col("_upto_total").alias("n"),
        "level",
        *[c for n in sums for c in (F.col(n), F.col(f"{n}_upto"), F.col(f"{n}_upto_total").alias(f"{n}_total"))],
    )


#: Rank functions as expressions over the columns of `value_positions`, or the fields of a struct of them.
RANK_FUNCTIONS = {
    "percent_rank": lambda at="": F.when(F.col(at + "n") > 1, F.col(at + "less") / (F.col(at + "n") - 1)).otherwise(F.lit(0.0)),
    "cume_dist": lambda at="": (F.col(at + "less") + F.col(at + "ties")) / F.col(at + "n"),
    "rank": lambda at="": F.col(at + "less") + 1,
    "dense_rank": lambda at="": F.col(at + "level"),
    "rank_average": lambda at="": F.col(at + "less") + (F.col(at + "ties") + 1) / 2,
    "rank_fraction": lambda at="": (F.col(at + "less") + (F.col(at + "ties") + 1) / 2) / F.col(at + "n"),
}


def with_value_ranks(
    df: DataFrame, group: Sequence[str], value: str, ranks: Mapping[str, str]
) -> DataFrame:
    """Add rank columns `{name: function}` of `value` inside each group to every row, in place.

    A block of several values holds all rows of each, so its own window ranks them; a value with blocks of its
    own has one rank, which comes from the block table.
    """
    rows = _in_blocks(df, group, F.col(value), None)
    if "dense_rank" in ranks.values():
        per_value = rows.groupBy(_KEY, value).agg(F.count(F.lit(1)).alias("_n"))
        table = per_value.groupBy(_KEY).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_levels"))
    else:  # no need to tell values apart
        table = rows.groupBy(_KEY).agg(F.count(F.lit(1)).alias("_n"), F.lit(0).alias("_levels"))
    groups, block_one = [F.col(f"{_KEY}.{c}") for c in group], f"{_KEY}.{_ONE}"
    whole, one = Window.partitionBy(*groups), Window.partitionBy(*groups, block_one)
    lower = whole.orderBy(block_one).rangeBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.row_number().over(one.orderBy(f"{_KEY}.{_TWO}")) == 1, F.col("_levels")).otherwise(0)
    table = table.withColumn("_fresh", fresh).select(
        F.col(_KEY).alias("_block"),
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"), F.coalesce(F.sum("_fresh").over(lower), F.lit(0)).alias("_seen"),
        F.sum("_n").over(one).alias("_alike"), F.sum("_n").over(whole).alias("_all"),
    )
    inside = Window.partitionBy(_KEY).orderBy(F.col(value).asc_nulls_last())
    local = rows.withColumns({
        "_rank": F.rank().over(inside), "_dense": F.dense_rank().over(inside),
        "_ties": F.count(F.lit(1)).over(Window.partitionBy(_KEY, value)),
    })
    alone = F.col(block_one) % 2 == 1
    joined = local.join(table, F.col(_KEY) == F.col("_block"))
    facts = {
        "less": F.col("_before") + F.when(alone, 0).otherwise(F.col("_rank") - 1), "level": F.col("_seen") + F.when(alone, 1).otherwise(F.col("_dense")),
        "ties": F.when(alone, F.col("_alike")).otherwise(F.col("_ties")), "n": F.col("_all"),
    }
    named = joined.withColumn("_facts", F.struct(*[e.cast("long").alias(k) for k, e in facts.items()]))
    return named.select(*df.columns, *[RANK_FUNCTIONS[f]("_facts.").alias(n) for n, f in ranks.items()])


def group_quantiles(
    df: DataFrame, group: Sequence[str], value: str, quantiles: Mapping[str, float], ties: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles of the non-NULL values of each group; `ties` names a column of copies, if rows are counted already.

    Works on distinct values and their running counts, so no task holds a whole group.
    """
    positions = value_positions(df.filter(F.col(value).isNotNull()), group, value, ties=ties)
    parts, outs = [], []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("n") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("less") <= index) & (index < F.col("less") + F.col("ties"))
            parts.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
        parts.append(F.max(at - F.floor(at)).alias(f"_w_{name}"))
        lo, hi, w = (F.col(f"_{k}_{name}") for k in ("lo", "hi", "w"))
        outs.append((lo + (hi - lo) * w).alias(name))
    return positions.groupBy(*group).agg(*parts).select(*group, *outs)


def unpivot(df: DataFrame, keep: Sequence[str], columns: Sequence[str], keep_nulls: bool = True) -> DataFrame:
    """Long form `(keep..., feature, value double)` of numeric columns."""
    long = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), "feature", "value"
    )
    return long if keep_nulls else long.filter(F.col("value").isNotNull())


def cells(df: DataFrame, keep: Sequence[str], columns: Sequence[str], keep_nulls: bool = True) -> DataFrame:
    """The long form with the column's place in `columns` instead of its name, for rows that are shuffled: `(keep..., place int, value double)`."""
    told = [x for i, c in enumerate(columns) for x in (F.lit(i), F.col(c).cast("double"))]
    long = df.select(*keep, F.stack(F.lit(len(columns)), *told).alias("place", "value"))
    return long if keep_nulls else long.filter(F.col("value").isNotNull())


def named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`place` of `cells` as `feature`, the column's name."""
    names = F.array(*[F.lit(c) for c in columns])
    return df.select(*[F.get(names, F.col(c)).alias("feature") if c == "place" else F.col(c) for c in df.columns])
