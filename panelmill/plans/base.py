"""Labelled panels shared by the registered queries, and the same CTEs as SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators.label import build_base, churn_label
from panelmill.plans.panels import bank_panel, bank_sql, order_period
from panelmill.sources.tables import table

E, P, L = K.ENTITY, K.PERIOD, K.LABEL


def bank_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The panel's calendar, from the order dates alone."""
    year = F.year("o_orderdate")
    return table(spark, folder, "orders").select(order_period(year).alias(P)).distinct()


def labelled(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    panel = bank_panel(spark, folder, None if columns is None else list(columns))
    return churn_label(panel, bank_periods(spark, folder))


def based(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    panel = bank_panel(spark, folder, None if columns is None else list(columns))
    return build_base(panel, periods=bank_periods(spark, folder))


#: Label by looking up the customer at the next two period positions, as CTEs after a `panel` CTE.
LABEL_CTES = f""",
positions as (select {P}, row_number() over (order by {P}) as pos, count(*) over () as fin from (select distinct {P} from panel)),
placed as (select {E}, pos, fin, {P} from panel join positions using ({P})),
tagged as (
  select a.{E}, a.{P}, case when a.pos = a.fin then null when b.pos is null then 'BAJA+1' when a.pos + 1 = a.fin then null
    when c.pos is null then 'BAJA+2' else 'CONTINUA' end as {L}
  from placed a left join placed b on b.{E} = a.{E} and b.pos = a.pos + 1 left join placed c on c.{E} = a.{E} and c.pos = a.pos + 2
),
labelled as (select panel.*, tagged.{L} from panel join tagged using ({E}, {P}))"""

LIFE_CTES = LABEL_CTES + f""",
life as (select {E}, max({P}) as {K.LAST_PERIOD}, count(*) as {K.N_PERIODS} from panel group by 1),
ending as (select max({P}) as fin from panel),
based as (
  select l.*, v.{K.LAST_PERIOD}, v.{K.N_PERIODS}, v.{K.LAST_PERIOD} < e.fin as {K.HAS_LEFT},
    cast(case when v.{K.LAST_PERIOD} < e.fin then case when v.{K.LAST_PERIOD} % 100 = 12
      then v.{K.LAST_PERIOD} + 89 else v.{K.LAST_PERIOD} + 1 end end as int) as {K.EXIT_PERIOD},
    cast((v.{K.LAST_PERIOD} // 100 - l.{P} // 100) * 12 + v.{K.LAST_PERIOD} % 100 - l.{P} % 100 as int) as {K.PERIODS_LEFT}
  from labelled l join life v using ({E}) cross join ending e
)"""


def labelled_sql(columns: Iterable[str] | None = None) -> str:
    return bank_sql(None if columns is None else list(columns)) + LABEL_CTES


def based_sql(columns: Iterable[str] | None = None) -> str:
    return bank_sql(None if columns is None else list(columns)) + LIFE_CTES


def lag_block_sql(columns: Iterable[str]) -> str:
    """The four history columns of each column over a window named `h`."""
    return "".join(
        f", cast(lag({c}, {n}) over h as float) as {c}__lag{n}, cast({c} - lag({c}, {n}) over h as float) as {c}__delta{n}"
        for c in columns
        for n in (1, 2)
    )


WINDOW_H = f"window h as (partition by {E} order by {P})"
