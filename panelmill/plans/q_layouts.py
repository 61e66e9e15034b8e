"""Queries on panels stored by entity and on presence kept as bits."""

from __future__ import annotations

from panelmill.operators import history as H
from panelmill.operators import presence as B
from panelmill.operators import repair as Q
from panelmill.operators.label import build_base, calendar
from panelmill.plans import datasets as D
from panelmill.plans.base import E, P, WINDOW_H, bank_periods, based_sql, lag_block_sql
from panelmill.plans.panels import bank_panel, bank_sql
from panelmill.plans.q_features import _LOSS_SQL
from panelmill.plans.registry import query
from panelmill.sources import by_entity as S

_LAID = ["ccajas_depositos", "cproductos", "ctrx_quarter", "mcuentas_saldo"]


@query(
    "entity_layout_panels", "JN3 JN6 IO4 PN1 PN3 PN7 PN2",
    based_sql(_LAID) + _LOSS_SQL + f""",
    j as (select b.* exclude (ccajas_depositos), case when b.{P} = 202105 then null else b.ccajas_depositos end as ccajas_depositos,
        d.p_delta, d.p_caida_desde_max3, d.p_perdio from based b join prod d using ({E}, {P}))
    select *{lag_block_sql(_LAID)} from j {WINDOW_H}""",
)
def entity_layout_panels(spark, folder):
    """A base stored once by entity; two panels are built from it and a repaired column joined, all where the rows lie."""
    stored = S.stored_by_entity(bank_panel(spark, folder, _LAID))
    base = build_base(stored, periods=bank_periods(spark, folder))
    loss = D.product_loss(stored).select(E, P, "p_delta", "p_caida_desde_max3", "p_perdio")
    repaired = stored.select(E, P, Q.null_in_periods("ccajas_depositos", D.BAD_DEPOSITS).alias("ccajas_depositos"))
    return H.add(S.with_columns_of(S.with_columns_of(base, loss), repaired), H.lag_block(_LAID))


def _bits(spark, folder):
    return B.bitmaps(bank_panel(spark, folder, ["ctrx_quarter"]), calendar(bank_periods(spark, folder)))


@query(
    "bitmap_base_rows", "PN1 PN2 WN2 AG8 JN2",
    based_sql(["ctrx_quarter"]) + f""",
    pasos as (select *, lag(pos) over (partition by {E} order by pos) as antes, min(pos) over (partition by {E}) as m0,
      max(pos) over (partition by {E}) as m1 from placed)
    select b.* exclude (ctrx_quarter), p.pos = p.m0 and p.pos > 1 as entra, p.pos = p.m1 and p.pos < p.fin as sale,
      cast(coalesce(p.pos - p.antes - 1, 0) as int) as hueco from based b join pasos p using ({E}, {P})""",
)
def bitmap_base_rows(spark, folder):
    """Label, lifetime, first and last appearance and gaps, all from one row of bits per customer."""
    return B.base_rows(_bits(spark, folder))


@query(
    "bitmap_flows", "AG7 JN7",
    bank_sql(["ctrx_quarter"]) + f""",
    v as (select {E}, min({P}) as m0, max({P}) as m1 from panel group by 1), lim as (select min({P}) as a, max({P}) as b from panel)
    select {P}, count(*) as stock, count(case when {P} = m0 and {P} > a then 1 end) as altas, count(case when {P} = m1 and {P} < b then 1 end) as bajas
    from panel join v using ({E}) cross join lim group by 1""",
)
def bitmap_flows(spark, folder):
    return B.flows(_bits(spark, folder))


@query(
    "bitmap_presence", "JN1 AG1",
    bank_sql(["ctrx_quarter"]) + f""",
    grid as (select * from (select distinct {E} from panel) cross join (select distinct {P} from panel))
    select {E}, {P}, cast(exists (select 1 from panel c where c.{E} = g.{E} and c.{P} = g.{P}) as int) as presente from grid g""",
)
def bitmap_presence(spark, folder):
    return B.presence_rows(_bits(spark, folder))
