"""Presence as one row of bits per entity: labels, lifetimes, entries, exits and gaps without windows over the panel.

The panel is shuffled once, by entity, and only as bits that are folded map-side. Bit i of the bitmap stands for the calendar's period
i + 1; a bitmap takes as many words of `WORD` bits as the calendar needs. Everything else is computed inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.period import add_periods, periods_between
from panelmill.operators.label import _ORD, calendar

E, P = K.ENTITY, K.PERIOD
WORD = 62


def bitmaps(panel: DataFrame, ordinals: DataFrame | None = None) -> DataFrame:
    """(entity, bits, periods): the bits of each entity, and all periods in order. `ordinals` may give the calendar.

    Rows whose period is NULL or not in the calendar count nowhere; repeated rows count once.
    """
    ordinals = calendar(panel.filter(F.col(P).isNotNull())) if ordinals is None else ordinals
    periods = [r[P] for r in ordinals.orderBy(P).collect()]  # one per period
    placed = panel.select(E, P).join(ordinals.select(P, (F.col(_ORD) - 1).alias("_at")), P)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % WORD).cast("int"))
    word = F.floor(F.col("_at") / WORD)
    words = [F.coalesce(F.bit_or(F.when(word == w, bit)), F.lit(0).cast("long")) for w in range(max(1, -(-len(periods) // WORD)))]
    return placed.groupBy(E).agg(F.array(*words).alias("bits")).withColumn("periods", F.array(*[F.lit(p) for p in periods]).cast("array<int>"))


def present(place: Column) -> Column:
    """Whether the period at this place, from 1, has its bit; false outside the calendar."""
    word = F.get("bits", F.floor((place - 1) / WORD).cast("int"))
    bit = F.call_function("shiftrightunsigned", word, ((place - 1) % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return F.coalesce((place >= 1) & (bit == 1), F.lit(False))


def presence_rows(bits: DataFrame) -> DataFrame:
    """(entity, period, presente) for every entity and period of the calendar."""
    each = bits.select(E, "bits", F.posexplode("periods").alias("_i", P))
    return each.select(E, P, present(F.col("_i") + 1).cast("int").alias("presente"))


def base_rows(bits: DataFrame, step: int = 1) -> DataFrame:
    """(entity, period, label, lifetime columns, entra, sale, hueco) of every present period.

    `entra` and `sale` mark the first and last appearance, but not in the calendar's first and last period; `hueco` counts the periods
    missing since the one before. `step` is how many months one period lasts.
    """
    places = F.filter(F.sequence(F.lit(1), F.size("periods")), present)
    own = bits.withColumn("_own", places).select(E, "bits", "periods", "_own", F.posexplode("_own").alias("_i", "_at"))
    at, n = F.col("_at"), F.size("periods")
    one, two = present(at + 1), present(at + 2)
    label = (
        F.when((at + 1 <= n) & ~one, K.LEAVES_NEXT).when((at + 2 <= n) & ~two, K.LEAVES_IN_TWO).when(at + 2 <= n, K.STAYS)
    )
    period, last = F.get("periods", at - 1), F.get("periods", F.array_max("_own") - 1)
    left = F.array_max("_own") < n
    return own.select(
        E, period.alias(P), label.alias(K.LABEL), last.alias(K.LAST_PERIOD), F.size("_own").cast("long").alias(K.N_PERIODS),
        left.alias(K.HAS_LEFT), F.when(left, add_periods(last, step)).alias(K.EXIT_PERIOD), periods_between(period, last).alias(K.PERIODS_LEFT),
        ((F.col("_i") == 0) & (at > 1)).alias("entra"), (left & (F.col("_i") == F.size("_own") - 1)).alias("sale"),
        F.when(F.col("_i") > 0, at - F.get("_own", F.col("_i") - 1) - 1).otherwise(0).cast("int").alias("hueco"),
    )


def flows(bits: DataFrame) -> DataFrame:
    """(period, stock, altas, bajas), counted map-side; none enters in the first period or leaves in the last."""
    counted = base_rows(bits).groupBy(P)
    return counted.agg(F.count(F.lit(1)).alias("stock"), F.count_if("entra").alias("altas"), F.count_if("sale").alias("bajas"))
