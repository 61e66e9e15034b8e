"""Queries on the panel itself: label, lifetime, presence, calendar arithmetic, flows, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.period import add_periods, index_period, period_index, periods_between
from panelmill.functions.scalars import clamped_ratio, count_positive, null_safe_sum, ratio, safe_ratio, sure_flag
from panelmill.functions.selectors import (
    allow_list,
    amount_columns,
    numeric_predictors,
    with_prefix,
    with_suffix,
)
from panelmill.operators import profile as R
from panelmill.operators.label import (
    build_base,
    churn_label,
    differences,
    label_from_grid,
    lifetime,
    presence_grid,
)
from panelmill.plans.base import E, L, P, bank_periods, based, based_sql, labelled, labelled_sql
from panelmill.plans.panels import BANK_MEASURES, MONTH_SQL, bank_panel, bank_sql, day_panel, DAY_SQL, month_panel
from panelmill.plans.registry import query


@query(
    "label_counts", "PN1 IO2 AG1 PR1 PR2 PR12 WN2",
    labelled_sql(["ctrx_quarter"])
    + f" select {P}, coalesce({L}, 'SIN_CLASE') as {L}, count(*) as n from labelled group by 1, 2",
)
def label_counts(spark, folder):
    panel = churn_label(bank_panel(spark, folder, ["ctrx_quarter"]), bank_periods(spark, folder))
    return panel.groupBy(P, F.coalesce(L, F.lit("SIN_CLASE")).alias(L)).agg(F.count(F.lit(1)).alias("n"))


@query("label_rows", "PN1 JN2 JN3 WN2", labelled_sql(["mcuentas_saldo"]) + " select * from labelled")
def label_rows(spark, folder):
    return labelled(spark, folder, ["mcuentas_saldo"])


_SPARSE_LABEL = MONTH_SQL + labelled_sql(["ctrx_quarter"])[len(bank_sql(["ctrx_quarter"])):]


@query("label_sparse_months", "PN1", _SPARSE_LABEL + " select * from labelled")
def label_sparse_months(spark, folder):
    return churn_label(month_panel(spark, folder))


@query(
    "presence_per_period", "JN1 JN2 AG1",
    bank_sql(["ctrx_quarter"]) + f""",
    grid as (select * from (select distinct {E} from panel) cross join (select distinct {P} from panel))
    select g.{E}, g.{P}, cast(case when c.{E} is null then 0 else 1 end as int) as presente
    from grid g left join panel c on c.{E} = g.{E} and c.{P} = g.{P}""",
)
def presence_per_period(spark, folder):
    return presence_grid(bank_panel(spark, folder, ["ctrx_quarter"]).select(E, P))


@query("lifetime_rows", "PN2 AG2 JN4", based_sql(["mcuentas_saldo"]) + " select * from based")
def lifetime_rows(spark, folder):
    return based(spark, folder, ["mcuentas_saldo"])


@query(
    "label_two_ways_differ", "IO14 WN2",
    labelled_sql(["ctrx_quarter"]) + f" select {P}, count(*) as filas, 0::bigint as distintas from labelled group by 1",
)
def label_two_ways_differ(spark, folder):
    """Rows per period, and how many of them the label from leads over the grid has otherwise."""
    panel = bank_panel(spark, folder, ["ctrx_quarter"])
    fast = churn_label(panel, bank_periods(spark, folder)).select(E, P, L)
    other = differences(fast, label_from_grid(panel.select(E, P)))
    rows = fast.select(P, F.lit(1).alias("fila"), F.lit(0).alias("distinta")).unionByName(
        other.select(P, F.lit(0).alias("fila"), F.lit(1).alias("distinta"))
    )
    return rows.groupBy(P).agg(F.sum("fila").alias("filas"), F.sum("distinta").alias("distintas"))


@query(
    "exit_cohorts", "PN2 AG2",
    based_sql(["ctrx_quarter"])
    + f" select {K.EXIT_PERIOD}, count(distinct {E}) as clientes, count(*) as fotos from based where {K.HAS_LEFT} group by 1",
)
def exit_cohorts(spark, folder):
    return (
        based(spark, folder, ["ctrx_quarter"]).filter(K.HAS_LEFT).groupBy(K.EXIT_PERIOD)
        .agg(F.count_distinct(E).alias("clientes"), F.count(F.lit(1)).alias("fotos"))
    )


@query(
    "period_arithmetic", "PR7 PR15",
    MONTH_SQL + f""", ref as (select max({P}) as fin from panel)
    select {E}, {P}, cast({P} // 100 * 12 + {P} % 100 - 1 as int) as indice,
      cast(({P} // 100 * 12 + {P} % 100 - 1) // 12 * 100 + ({P} // 100 * 12 + {P} % 100 - 1) % 12 + 1 as int) as vuelta,
      cast(({P} // 100 * 12 + {P} % 100 + 4) // 12 * 100 + ({P} // 100 * 12 + {P} % 100 + 4) % 12 + 1 as int) as mas_cinco,
      cast(({P} // 100 * 12 + {P} % 100 - 4) // 12 * 100 + ({P} // 100 * 12 + {P} % 100 - 4) % 12 + 1 as int) as menos_tres,
      cast(fin // 100 * 12 + fin % 100 - {P} // 100 * 12 - {P} % 100 as int) as edad
    from panel cross join ref""",
)
def period_arithmetic(spark, folder):
    panel = month_panel(spark, folder)
    end = panel.select(F.max(P)).scalar()
    p = F.col(P)
    return panel.select(
        E, P, period_index(p).alias("indice"), index_period(period_index(p)).alias("vuelta"),
        add_periods(p, 5).alias("mas_cinco"), add_periods(p, -3).alias("menos_tres"),
        periods_between(p, end).alias("edad"),
    )


_SCALARS = ["mcuentas_saldo", "mpayroll", "mcaja_ahorro", "mcuenta_corriente", "Visa_msaldototal",
            "Visa_mpagado", "ctrx_quarter", "cproductos", "Visa_status"]


@query(
    "null_aware_arithmetic", "PR8 PR9 PR10 PR11 PR13 PR14",
    bank_sql(_SCALARS) + f"""
    select {E}, {P}, coalesce(mpayroll, 0) + coalesce(mcaja_ahorro, 0) as suma,
      coalesce(mpayroll, 0) / nullif(coalesce(mcuenta_corriente, 0), 0) as ratio_cero,
      cast(mcuentas_saldo / nullif(mpayroll, 0) as float) as ratio_nulo,
      Visa_mpagado / nullif(greatest(Visa_msaldototal, 0), 0) as ratio_acotado,
      cast(case when mpayroll > 0 then 1 else 0 end + case when mcaja_ahorro > 0 then 1 else 0 end as int) as positivos,
      cast(coalesce(Visa_status in (6, 7, 9), false) as int) as cerrando,
      cast(ctrx_quarter as tinyint) as trx_corto, abs(mcuentas_saldo) as tamano,
      cast(nullif(ctrx_quarter, 0) as double) as trx_sin_cero
    from panel""",
)
def null_aware_arithmetic(spark, folder):
    return bank_panel(spark, folder, _SCALARS).select(
        E, P, null_safe_sum("mpayroll", "mcaja_ahorro").alias("suma"),
        safe_ratio("mpayroll", "mcuenta_corriente").alias("ratio_cero"),
        ratio("mcuentas_saldo", "mpayroll").cast("float").alias("ratio_nulo"),
        clamped_ratio("Visa_mpagado", "Visa_msaldototal").alias("ratio_acotado"),
        count_positive("mpayroll", "mcaja_ahorro").alias("positivos"),
        sure_flag(F.col("Visa_status").isin(6, 7, 9)).alias("cerrando"),
        F.col("ctrx_quarter").cast("byte").alias("trx_corto"), F.abs("mcuentas_saldo").alias("tamano"),
        F.nullif("ctrx_quarter", F.lit(0)).cast("double").alias("trx_sin_cero"),
    )


@query(
    "column_selection", "PR1 PR3 PR4 PR5 PR6",
    based_sql(["mcuentas_saldo", "mpayroll", "ctrx_quarter", "Visa_mpagado", "Visa_status", "Visa_Finiciomora"])
    + f" select {E}, {P}, {L}, mcuentas_saldo, mpayroll, Visa_mpagado, Visa_status from based",
)
def column_selection(spark, folder):
    """Amounts and statuses among the numeric predictors, through the selectors."""
    panel = based(
        spark, folder, ["mcuentas_saldo", "mpayroll", "ctrx_quarter", "Visa_mpagado", "Visa_status", "Visa_Finiciomora"]
    )
    usable = numeric_predictors(panel)
    return allow_list(panel, amount_columns(usable) + with_suffix(with_prefix(usable, "Visa_"), "_status"))


# --- profiles ---------------------------------------------------------------------------------

@query(
    "stock_entries_exits", "AG7 JN7",
    bank_sql(["ctrx_quarter"]) + f""",
    v as (select {E}, min({P}) as m0, max({P}) as m1 from panel group by 1),
    lim as (select min({P}) as a, max({P}) as b from panel)
    select {P}, count(*) as stock,
      (select count(*) from v, lim where v.m0 = x.{P} and x.{P} > lim.a) as altas,
      (select count(*) from v, lim where v.m1 = x.{P} and x.{P} < lim.b) as bajas
    from panel x group by 1""",
)
def stock_entries_exits(spark, folder):
    return R.flows(bank_panel(spark, folder, ["ctrx_quarter"]).select(E, P))


_NULLABLE = list(BANK_MEASURES)


@query(
    "null_rates", "AG6",
    bank_sql(_NULLABLE) + " union all ".join(
        f" select {P}, '{c}' as feature, cast(sum(case when {c} is null then 1 else 0 end) as double) / count(*) as tasa_nulos"
        f" from panel group by 1" for c in _NULLABLE
    ),
)
def null_rates(spark, folder):
    return R.null_rates(bank_panel(spark, folder, _NULLABLE), _NULLABLE)


#: Every counter above zero, and every status of a card.
_COUNTERS = [c for c in BANK_MEASURES if c.startswith("c")]
_STATUSES = [c for c in BANK_MEASURES if c.endswith("_status")]
_RATES = {c: f"{c} > 0" for c in _COUNTERS} | {f"{c}_{v}": f"{c} = {v}" for c in _STATUSES for v in (0, 6, 7, 9)}
_RATE_COLUMNS = _COUNTERS + _STATUSES
_RATE_SQL = bank_sql(_RATE_COLUMNS) + ", tasas as (" + " union all ".join(
    f"select {P}, '{n}' as condicion, 100.0::double * cast(sum(case when {c} then 1 else 0 end) as double) / count(*) as tasa"
    " from panel group by 1" for n, c in _RATES.items()
) + ")"


@query("condition_rates", "AG5", _RATE_SQL + f" select {P}, condicion, round(tasa, 8) as tasa from tasas")
def condition_rates(spark, folder):
    rates = R.condition_rates(bank_panel(spark, folder, _RATE_COLUMNS), _RATES)
    return rates.withColumn("tasa", F.round("tasa", 8))


@query(
    "odd_periods", "AG11",
    _RATE_SQL + f""", m as (select condicion, median(tasa) as mediana from tasas group by 1)
    select {P}, condicion, round(tasa, 8) as tasa, round(mediana, 8) as mediana,
      abs(tasa - mediana) > greatest(0.25 * mediana, 0.3) as raro
    from tasas join m using (condicion)""",
)
def odd_periods(spark, folder):
    rates = R.condition_rates(bank_panel(spark, folder, _RATE_COLUMNS), _RATES)
    odd = R.odd_periods(rates)
    return odd.withColumns({"tasa": F.round("tasa", 8), "mediana": F.round("mediana", 8)})


@query(
    "red_rate_by_class", "AG5 AG12",
    labelled_sql(["mcuentas_saldo"]) + f"""
    select {P}, {", ".join(f'''round(100.0::double * sum(case when {L} = '{c}' and mcuentas_saldo < 0 then 1.0::double else 0 end)
      / nullif(count(case when {L} = '{c}' then 1 end), 0), 8) as "{c}"''' for c in ("BAJA+1", "BAJA+2", "CONTINUA"))}
    from labelled where {L} is not null group by 1""",
)
def red_rate_by_class(spark, folder):
    return R.rate_by_class(labelled(spark, folder, ["mcuentas_saldo"]), F.col("mcuentas_saldo") < 0, digits=8)


_PATH_COLUMNS = ["ctrx_quarter", "mcuentas_saldo", "Visa_status"]


@query(
    "exit_trajectory", "AG8",
    based_sql(_PATH_COLUMNS) + f"""
    select cast(case when {K.HAS_LEFT} then {K.PERIODS_LEFT} end as int) as {K.PERIODS_LEFT},
      median(cast(ctrx_quarter as double)) as mediana_trx,
      round(100.0::double * avg(case when mcuentas_saldo < 0 then 1 else 0 end), 8) as en_rojo,
      round(100.0::double * avg(case when Visa_status in (6, 7, 9) then 1 else 0 end), 8) as visa_cerrada, count(*) as n
    from based group by 1""",
)
def exit_trajectory(spark, folder):
    """By months to exit; the row with NULL is the base of those who stay."""
    return R.exit_trajectory(based(spark, folder, _PATH_COLUMNS))


@query(
    "lag_autocorrelation", "AG10",
    bank_sql(_NULLABLE)
    + ", l as (select *, " + ", ".join(
        f"lag({c}, 1) over h as {c}__lag1" for c in _NULLABLE)
    + f" from panel window h as (partition by {E} order by {P})) "
    + " union all ".join(
        f"select '{c}' as feature, round(corr({c}, {c}__lag1), 8) as rho from l where {P} >= 202104"
        for c in _NULLABLE),
)
def lag_autocorrelation(spark, folder):
    return R.autocorrelation(bank_panel(spark, folder), _NULLABLE, first_period=202104)


@query(
    "empirical_distribution", "AG15",
    labelled_sql(["mcuentas_saldo"]) + f"""
    select distinct {L}, mcuentas_saldo, cume_dist() over (partition by {L} order by mcuentas_saldo) as fraccion
    from labelled where {P} between 202103 and 202106 and {L} in ('CONTINUA', 'BAJA+2')""",
)
def empirical_distribution(spark, folder):
    panel = labelled(spark, folder, ["mcuentas_saldo"]).filter(F.col(P).between(202103, 202106))
    return R.empirical_distribution(panel.filter(F.col(L).isin(K.STAYS, K.LEAVES_IN_TWO)), L, "mcuentas_saldo")


@query(
    "class_separation", "AG19 AG15",
    labelled_sql(_NULLABLE) + f""",
    x as ({" union all ".join(f"select {P}, {L} = 'BAJA+2' as y, '{c}' as feature, cast({c} as double) as value from labelled where {L} is not null and {c} is not null" for c in _NULLABLE)}),
    c as (select {P}, feature, value, sum(case when y then 1 else 0 end) as p, sum(case when y then 0 else 1 end) as q
      from x group by 1, 2, 3),
    r as (select {P}, feature, sum(p) over w / nullif(sum(p) over g, 0) as fp, sum(q) over w / nullif(sum(q) over g, 0) as fq
      from c window w as (partition by {P}, feature order by value), g as (partition by {P}, feature))
    select {P}, feature, round(max(abs(fp - fq)), 9) as ks from r group by 1, 2""",
)
def class_separation(spark, folder):
    return R.ks_separation(labelled(spark, folder).filter(F.col(L).isNotNull()), _NULLABLE)


@query(
    "bucket_histogram", "AG16",
    bank_sql(["mcuentas_saldo", "ctrx_quarter"]) + f"""
    select {P}, cast(least(greatest(floor((mcuentas_saldo + 1000000) / 100000) + 1, 0), 21) as bigint) as tramo, count(*) as n
    from panel group by 1, 2""",
)
def bucket_histogram(spark, folder):
    panel = bank_panel(spark, folder, ["mcuentas_saldo", "ctrx_quarter"])
    return R.histogram(panel, "mcuentas_saldo", -1_000_000, 1_000_000, 20)


@query(
    "control_averages", "AG20 IO11",
    bank_sql(["mcuentas_saldo", "cproductos", "ctrx_quarter"]) + f""",
    c as (select *, lag(mcuentas_saldo, 2) over (partition by {E} order by {P}) as l2 from panel)
    select {P}, count(*) as filas, round(avg(cproductos), 8) as productos, round(avg(ctrx_quarter), 8) as trx,
      round(median(case when mcuentas_saldo > 0 then (mcuentas_saldo - l2) / mcuentas_saldo end), 8) as mediana_delta2
    from c group by 1""",
)
def control_averages(spark, folder):
    return R.control_averages(bank_panel(spark, folder, ["mcuentas_saldo", "cproductos", "ctrx_quarter"]))


@query(
    "dataset_shape", "IO11",
    bank_sql(["mcuentas_saldo", "cproductos"]) + f"""
    select {P}, count(*) as filas, count(distinct {E}) as clientes, count(mcuentas_saldo) as con_saldo,
      cast(4 as int) as columnas from panel group by 1""",
)
def dataset_shape(spark, folder):
    panel = bank_panel(spark, folder, ["mcuentas_saldo", "cproductos"])
    return panel.groupBy(P).agg(
        F.count(F.lit(1)).alias("filas"), F.count_distinct(E).alias("clientes"),
        F.count("mcuentas_saldo").alias("con_saldo"), F.lit(len(panel.columns)).alias("columnas"),
    )


@query(
    "view_rollup", "IO12 PR12 JN8",
    bank_sql(["mcuentas_saldo", "ctrx_quarter"]) + f"""
    select {P}, count(*) as n, round(avg(case when mcuentas_saldo < 0 then 1.0::double else 0 end)
      / (select avg(case when mcuentas_saldo < 0 then 1.0::double else 0 end) from panel), 8) as veces
    from panel where {P} in (202104, 202105, 202106) group by 1""",
)
def view_rollup(spark, folder):
    bank_panel(spark, folder, ["mcuentas_saldo", "ctrx_quarter"]).createOrReplaceTempView("panel_rojo")
    return spark.sql(
        f"""select {P}, count(*) as n, round(avg(if(mcuentas_saldo < 0, 1D, 0D))
              / (select avg(if(mcuentas_saldo < 0, 1D, 0D)) from panel_rojo), 8) as veces
            from panel_rojo where {P} in (202104, 202105, 202106) group by 1"""
    )


@query("day_panel_rows", "PN1 IO2", DAY_SQL + " select * from panel")
def day_panel_rows(spark, folder):
    return day_panel(spark, folder)
