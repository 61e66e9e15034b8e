"""Panel profiles: flows, NULL rates, condition rates, trajectories, lift, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators.history import history
from panelmill.operators.ordered import RANK_FUNCTIONS, cells, group_quantiles, named, ntile_of, row_numbers, value_positions

E, P, L = K.ENTITY, K.PERIOD, K.LABEL


def flows(panel: DataFrame) -> DataFrame:
    """Stock, first and last appearances per period; none at the two ends of the window."""
    spans = panel.groupBy(E).agg(F.min(P).alias("m0"), F.max(P).alias("m1"))
    ends = panel.agg(F.min(P).alias("a"), F.max(P).alias("b"))
    moves = spans.select(F.explode(F.array(
        F.struct(F.col("m0").alias(P), F.lit(1).alias("alta"), F.lit(0).alias("baja")),
        F.struct(F.col("m1").alias(P), F.lit(0).alias("alta"), F.lit(1).alias("baja")),
    )).alias("m")).select("m.*")
    counted = moves.groupBy(P).agg(F.sum("alta").alias("altas"), F.sum("baja").alias("bajas"))
    stock = panel.groupBy(P).agg(F.count(F.lit(1)).alias("stock"))
    first, last = ends.select("a").scalar(), ends.select("b").scalar()
    return stock.join(counted, P, "left").select(
        P, "stock",
        F.when(F.col(P) > first, F.coalesce("altas", F.lit(0))).otherwise(0).cast("long").alias("altas"),
        F.when(F.col(P) < last, F.coalesce("bajas", F.lit(0))).otherwise(0).cast("long").alias("bajas"),
    )


def null_rates(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(period, feature, tasa_nulos): one wide aggregate, then turned into rows."""
    wide = panel.groupBy(P).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return wide.unpivot([P], list(columns), "feature", "tasa_nulos")


def condition_rates(panel: DataFrame, conditions: Mapping[str, str]) -> DataFrame:
    """(period, condicion, tasa): percent of rows with each condition; unknown counts as no."""
    wide = panel.groupBy(P).agg(
        *[(100.0 * F.count_if(F.expr(c)) / F.count(F.lit(1))).alias(n) for n, c in conditions.items()]
    )
    return wide.unpivot([P], list(conditions), "condicion", "tasa")


def odd_periods(rates: DataFrame, share: float = 0.25, floor: float = 0.3) -> DataFrame:
    """Mark the periods in which a rate is far from its median over the periods."""
    over_periods = Window.partitionBy("condicion")
    return rates.withColumn("mediana", F.median("tasa").over(over_periods)).withColumn(
        "raro", F.abs(F.col("tasa") - F.col("mediana")) > F.greatest(share * F.col("mediana"), F.lit(floor))
    )


def rate_by_class(panel: DataFrame, condition: Column, digits: int = 8) -> DataFrame:
    """Percent with a condition, periods down and classes across."""
    known = panel.filter(F.col(L).isNotNull())
    rate = F.round(100.0 * F.count_if(condition) / F.count(F.lit(1)), digits)
    return known.groupBy(P).pivot(L, [K.LEAVES_NEXT, K.LEAVES_IN_TWO, K.STAYS]).agg(rate)


def exit_trajectory(base: DataFrame) -> DataFrame:
    """Activity and risk by months to exit, and (NULL) among those who never leave.

    The medians come from value counts, so the large group of stayers is not one task.
    """
    path = base.withColumn("_k", F.when(F.col(K.HAS_LEFT), F.col(K.PERIODS_LEFT)).otherwise(-1))
    rates = path.groupBy("_k").agg(
        F.round(100.0 * F.count_if(F.col("mcuentas_saldo") < 0) / F.count(F.lit(1)), 8).alias("en_rojo"),
        F.round(100.0 * F.count_if(F.col("Visa_status").isin(6, 7, 9)) / F.count(F.lit(1)), 8).alias("visa_cerrada"),
        F.count(F.lit(1)).alias("n"),
    )
    medians = group_quantiles(path, ["_k"], "ctrx_quarter", {"mediana_trx": 0.5})
    return rates.join(medians, "_k", "left").select(
        F.when(F.col("_k") >= 0, F.col("_k")).cast("int").alias(K.PERIODS_LEFT),
        "mediana_trx", "en_rojo", "visa_cerrada", "n",
    )


def autocorrelation(panel: DataFrame, columns: Sequence[str], first_period: int, digits: int = 8) -> DataFrame:
    """(feature, rho): correlation of each column with its previous row."""
    lagged = panel.withColumns({f"{c}__lag1": F.lag(c, 1).over(history()) for c in columns})
    wide = lagged.filter(F.col(P) >= first_period).agg(
        *[F.round(F.corr(c, f"{c}__lag1"), digits).alias(c) for c in columns]
    )
    return wide.unpivot([], list(columns), "feature", "rho")


def empirical_distribution(panel: DataFrame, group: str, column: str) -> DataFrame:
    """(group, x, fraccion): share of the group at or below each value."""
    return value_positions(panel, [group], column).select(
        group, column, RANK_FUNCTIONS["cume_dist"]().alias("fraccion")
    )


def ks_separation(panel: DataFrame, columns: Sequence[str], positive: str = K.LEAVES_IN_TWO, digits: int = 9) -> DataFrame:
    """(period, feature, ks): largest distance between the class distributions of a column."""
    y = (F.col(L) == positive).cast("int")
    long = cells(panel.withColumn("_y", y), [P, "_y"], columns, keep_nulls=False)
    runs = value_positions(
        long, [P, "place"], "value", {"pos": F.sum("_y"), "neg": F.sum(1 - F.col("_y"))}
    )
    gap = F.abs(
        F.try_divide(F.col("pos_upto"), F.col("pos_total")) - F.try_divide(F.col("neg_upto"), F.col("neg_total"))
    )
    return named(runs.groupBy(P, "place").agg(F.round(F.max(gap), digits).alias("ks")), columns)


def histogram(panel: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """(period, tramo, n) over equal buckets; 0 and buckets + 1 catch what lies outside."""
    bucket = F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return panel.groupBy(P, bucket.alias("tramo")).agg(F.count(F.lit(1)).alias("n"))


def control_averages(panel: DataFrame) -> DataFrame:
    """What to look at after a build: rows, averages, and the median relative change over two rows."""
    change = F.when(
        F.col("mcuentas_saldo") > 0,
        (F.col("mcuentas_saldo") - F.lag("mcuentas_saldo", 2).over(history())) / F.col("mcuentas_saldo"),
    )
    with_change = panel.withColumn("_cambio", change)
    averages = with_change.groupBy(P).agg(
        F.count(F.lit(1)).alias("filas"),
        F.round(F.avg("cproductos"), 8).alias("productos"),
        F.round(F.avg("ctrx_quarter"), 8).alias("trx"),
    )
    medians = group_quantiles(with_change, [P], "_cambio", {"mediana_delta2": 0.5})
    return averages.join(medians, P, "left").withColumn("mediana_delta2", F.round("mediana_delta2", 8))


def lift_table(
    panel: DataFrame, flags: Mapping[str, str], coverage_period: int, active: str = "ctrx_quarter >= 1",
    positive: str = K.LEAVES_IN_TWO, digits: int = 8,
) -> DataFrame:
    """Per flag: rows, positive rate, lift over the base rate, coverage in a period, lift among actives.

    One pass: every count of every flag is a conditional sum of the same aggregate.
    """
    known, y, act = F.col(L).isNotNull(), F.col(L) == positive, F.expr(active)
    in_period = F.col(P) == coverage_period
    parts = {
        "n": lambda f: F.count_if(known & f),
        "pos": lambda f: F.count_if(known & y & f),
        "nact": lambda f: F.count_if(known & act & f),
        "posact": lambda f: F.count_if(known & y & act & f),
        "cov": lambda f: F.count_if(in_period & f),
    }
    everything = {"_todo": "true", **flags}
    wide = panel.agg(*[
        part(F.coalesce(F.expr(cond), F.lit(False))).alias(f"{k}~{name}")
        for name, cond in everything.items() for k, part in parts.items()
    ])
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("flag"), *[F.col(f"{k}~{name}").alias(k) for k in parts],
                 *[F.col(f"{k}~_todo").alias(f"{k}0") for k in parts])
        for name in flags
    ]))
    rate = F.try_divide(F.col("pos"), F.col("n"))
    rate_active = F.try_divide(F.col("posact"), F.col("nact"))
    return wide.select(rows.alias("r")).select("r.*").select(
        "flag", "n",
        F.round(rate, digits).alias("tasa"),
        F.round(F.try_divide(rate, F.col("pos0") / F.col("n0")), digits).alias("lift"),
        F.round(100.0 * F.col("cov") / F.col("cov0"), digits).alias("cobertura"),
        F.round(F.try_divide(rate_active, F.col("posact0") / F.col("nact0")), digits).alias("lift_activos"),
    )


def decile_lift(panel: DataFrame, column: str, positive: str = K.LEAVES_IN_TWO, digits: int = 8) -> DataFrame:
    """Positive rate of each decile of a column over the period's base rate."""
    known = panel.filter(F.col(L).isNotNull())
    numbered = row_numbers(known, [P], [F.col(column).asc_nulls_last(), F.col(E).asc()], [F.col(column), F.col(E)], "_rn", "_n")
    y = F.count_if(F.col(L) == positive)
    deciles = numbered.groupBy(P, ntile_of(10, F.col("_rn"), F.col("_n")).alias("decil")).agg(
        F.count(F.lit(1)).alias("n"), y.alias("positivos")
    )
    whole = Window.partitionBy(P)
    base = F.sum("positivos").over(whole) / F.sum("n").over(whole)
    return deciles.select(
        P, "decil", "n", "positivos",
        F.round(F.try_divide(F.col("positivos") / F.col("n"), base), digits).alias("lift"),
    )


def calendar_scan(panel: DataFrame, columns: Sequence[str], target: int, against: Sequence[int], digits: int = 8) -> DataFrame:
    """Share of negatives among the non-zero values of derived columns, target period against others."""
    wide = panel.filter(F.col(P).isin(target, *against)).groupBy(P).agg(
        *[F.try_divide(F.count_if(F.col(c) < 0), F.count_if(F.col(c) != 0)).alias(c) for c in columns]
    )
    shares = wide.unpivot([P], list(columns), "feature", "negativos")
    return shares.groupBy("feature").agg(
        *[F.round(F.max(F.when(F.col(P) == p, F.col("negativos"))), digits).alias(f"neg_{p}") for p in (target, *against)],
        F.round(
            F.max(F.when(F.col(P) == target, F.col("negativos")))
            - F.avg(F.when(F.col(P) != target, F.col("negativos"))), digits
        ).alias("distorsion"),
    )


def rate_by_streak(panel: DataFrame, streak: str, period: int, positive: str = K.LEAVES_IN_TWO, digits: int = 8) -> DataFrame:
    return panel.filter(F.col(P) == period).groupBy(streak).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(100.0 * F.count_if(F.col(L) == positive) / F.count(F.lit(1)), digits).alias("pct_positivos"),
    )
