"""Who leaves and when: row labels, lifetime columns, presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.period import add_periods, periods_between
from panelmill.session import broadcast_if_small

_ORD, _LAST = "_ordinal", "_last_ordinal"


def period_ordinals(panel: DataFrame) -> DataFrame:
    """One row per observed period with its dense position and the position of the last one."""
    periods = panel.select(K.PERIOD).distinct()
    in_order = Window.orderBy(K.PERIOD)
    return periods.select(
        K.PERIOD,
        F.row_number().over(in_order).alias(_ORD),
        F.count(F.lit(1)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .cast("int").alias(_LAST),
    )


def calendar(panel: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """The materialised calendar of a panel, or of `periods`, for labels and lifetimes: one row per period."""
    return broadcast_if_small(period_ordinals(panel if periods is None else periods))


def churn_label(panel: DataFrame, periods: DataFrame | None = None, ordinals: DataFrame | None = None) -> DataFrame:
    """Add the ternary label from presence in the next two observed periods.

    Equivalent to leads over the full entity x period grid, without building the grid: the
    next row of an entity is compared by period position. `periods` may name the calendar, `ordinals` give it.
    """
    ordinals = calendar(panel, periods) if ordinals is None else ordinals
    history = Window.partitionBy(K.ENTITY).orderBy(_ORD)
    o, last = F.col(_ORD), F.col(_LAST)
    one, two = F.lead(_ORD, 1).over(history), F.lead(_ORD, 2).over(history)
    marked = panel.join(ordinals, K.PERIOD).withColumns({
        "_in_1": F.coalesce(one == o + 1, F.lit(False)),
        "_in_2": F.coalesce(one == o + 2, F.lit(False)) | F.coalesce(two == o + 2, F.lit(False)),
    })
    label = (
        F.when((o + 1 <= last) & ~F.col("_in_1"), K.LEAVES_NEXT)
        .when((o + 2 <= last) & F.col("_in_1") & ~F.col("_in_2"), K.LEAVES_IN_TWO)
        .when((o + 2 <= last) & F.col("_in_1") & F.col("_in_2"), K.STAYS)
    )
    return marked.withColumn(K.LABEL, label).drop(_ORD, _LAST, "_in_1", "_in_2")


def lifetime(panel: DataFrame, step: int = 1, last: int | None = None) -> DataFrame:
    """Add last period, number of periods, left-or-not, exit period and periods left.

    `step` is how many months one period lasts, `last` the panel's last period if known. The window has
    the partitioning of `churn_label`, so the two together shuffle the panel once.
    """
    own = Window.partitionBy(K.ENTITY)
    end = panel.select(F.max(K.PERIOD).alias("_end")).scalar() if last is None else F.lit(last)
    with_last = panel.withColumns({
        K.LAST_PERIOD: F.max(K.PERIOD).over(own),
        K.N_PERIODS: F.count(F.lit(1)).over(own),
    })
    left = F.col(K.LAST_PERIOD) < end
    return with_last.withColumns({
        K.HAS_LEFT: left,
        K.EXIT_PERIOD: F.when(left, add_periods(F.col(K.LAST_PERIOD), step)),
        K.PERIODS_LEFT: periods_between(F.col(K.PERIOD), F.col(K.LAST_PERIOD)),
    })


def build_base(panel: DataFrame, step: int = 1, periods: DataFrame | None = None) -> DataFrame:
    """Raw panel -> panel with label and lifetime columns.

    The calendar is read once, from `periods` if given; beyond it the panel is scanned once.
    """
    ordinals = calendar(panel, periods)
    last = ordinals.agg(F.max(K.PERIOD)).first()[0]
    return lifetime(churn_label(panel, ordinals=ordinals), step, last)


def presence_grid(panel: DataFrame) -> DataFrame:
    """Every entity x observed period with 1 / 0 for present.

    The periods of an entity are gathered into one short array (at most as many as there
    are periods) and laid against the array of all periods: no join of entities and periods.
    """
    calendar = panel.select(F.array_sort(F.collect_set(K.PERIOD)).alias("_all")).scalar()
    return (
        panel.groupBy(K.ENTITY)
        .agg(F.collect_set(K.PERIOD).alias("_own"))
        .withColumn(K.PERIOD, F.explode(calendar))
        .select(K.ENTITY, K.PERIOD, F.array_contains("_own", F.col(K.PERIOD)).cast("int").alias("presente"))
    )


def label_from_grid(panel: DataFrame) -> DataFrame:
    """`(entity, period, label)` for present rows by leads over the full grid."""
    history = Window.partitionBy(K.ENTITY).orderBy(K.PERIOD)
    next_1, next_2 = (F.lead("presente", n).over(history) for n in (1, 2))
    return (
        presence_grid(panel)
        .withColumns({"_n1": next_1, "_n2": next_2})
        .filter("presente = 1")
        .select(
            K.ENTITY,
            K.PERIOD,
            F.when((F.col("_n1") == 1) & (F.col("_n2") == 0), K.LEAVES_IN_TWO)
            .when(F.col("_n1") == 0, K.LEAVES_NEXT)
            .when((F.col("_n1") == 1) & (F.col("_n2") == 1), K.STAYS)
            .alias(K.LABEL),
        )
    )


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one frame that the other lacks, as often as it lacks them, marked by side.

    Empty when the two are equal. Both are read once: rows are counted with a sign per side.
    """
    columns = left.columns
    signed = left.withColumn("_lado", F.lit(1)).unionByName(right.withColumn("_lado", F.lit(-1)))
    excess = signed.groupBy(*columns).agg(F.sum("_lado").alias("_mas")).filter("_mas <> 0")
    side = F.when(F.col("_mas") > 0, "izquierda").otherwise("derecha")
    return excess.select(*columns, side.alias("solo_en"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_mas"))).alias("_vez")).drop("_vez")
