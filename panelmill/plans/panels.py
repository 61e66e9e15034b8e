"""Entity x period panels derived from the driver's tables.

Every measure is written once, as an aggregate expression that Spark SQL and ANSI SQL read alike, and
used both by the Spark panel and by the check SQL. Money is summed in whole cents, so
sums do not depend on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.period import index_period
from panelmill.sources.tables import table

# --- bank-shaped panel: customer x order year, years 1995.. stand for months 202103.. ---------

_LINE_MEASURES = {
    "n_lines": "count(*)",
    "qty": "sum(cast(l_quantity as bigint))",
    "n_ret": "sum(case when l_returnflag = 'R' then 1 else 0 end)",
    "n_ret_open": "sum(case when l_returnflag = 'R' and l_linestatus = 'O' then 1 else 0 end)",
    "n_acc": "sum(case when l_returnflag = 'A' then 1 else 0 end)",
    "n_new": "sum(case when l_returnflag = 'N' then 1 else 0 end)",
    "c_ext": "sum(cast(round(l_extendedprice * 100) as bigint))",
    "c_ext_done": "sum(case when l_linestatus = 'F' then cast(round(l_extendedprice * 100) as bigint) end)",
    "c_ext_open": "sum(case when l_linestatus = 'O' then cast(round(l_extendedprice * 100) as bigint) end)",
    "c_ret": "sum(case when l_returnflag = 'R' then cast(round(l_extendedprice * 100) as bigint) end)",
    "c_disc": "sum(cast(round(l_extendedprice * l_discount * 100) as bigint))",
    "c_tax": "sum(cast(round(l_extendedprice * l_tax * 100) as bigint))",
    "c_tax_new": "sum(case when l_returnflag = 'N' then cast(round(l_extendedprice * l_tax * 100) as bigint) end)",
    "c_tax_acc": "sum(case when l_returnflag = 'A' then cast(round(l_extendedprice * l_tax * 100) as bigint) end)",
}


#: Order years are consecutive months: 1993 stands for 202101, whatever the first and last year are.
_MONTHS = 2021 * 12 - 1993


def order_period(year: Column) -> Column:
    return index_period((F.lit(_MONTHS) + year).cast("int")).cast("int")


def _count(cond: str) -> str:
    return f"cast(sum(case when {cond} then 1 else 0 end) as int)"


def _total(column: str) -> str:
    return f"cast(coalesce(sum({column}), 0) as int)"


def _money(cents: str, cond: str = "true") -> str:
    return f"cast(sum(case when {cond} then {cents} end) as double) / cast(100 as double)"


def _card(card: str, prio: str, status: str) -> dict[str, str]:
    """Card columns of one card; NULL in every one of them when there is no such card."""
    own = f"prio = {prio}"
    n = f"sum(case when {own} then 1 end)"
    return {
        f"{card}_mlimitecompra": _money("c_price * 2", own),
        f"{card}_msaldototal": _money(f"case when status = '{status}' then -c_price else c_price end", own),
        f"{card}_mconsumototal": _money("c_tax", own),
        f"{card}_mpagado": _money("c_disc", own),
        f"{card}_mpagominimo": _money("c_tax_new", own),
        f"{card}_mfinanciacion_limite": _money("case when n_ret = 0 then c_price * 40 else c_price end", own),
        f"{card}_status": f"cast(case {n} when 1 then 0 when 2 then 6 when 3 then 7 when 4 then 9 end as int)",
        f"{card}_delinquency": f"cast(max(case when {own} and status = '{status}' then 1 when {own} then 0 end) as int)",
        f"{card}_Finiciomora": f"cast(min(case when {own} and status = '{status}' then n_ret end) as int)",
        f"{card}_Fvencimiento": f"cast(min(case when {own} and n_lines = 1 then -9999999 when {own} then -mon * 30 end) as int)",
    }


#: Bank column -> aggregate over the customer's orders of the year.
BANK_MEASURES: dict[str, str] = {
    "ctrx_quarter": _count("status = 'F'"),
    "active_quarter": "cast(max(case when mon >= 4 then 1 else 0 end) as int)",
    "cproductos": "cast(" + " + ".join(f"max(case when prio = {i} then 1 else 0 end)" for i in range(1, 6)) + " as int)",
    "cliente_vip": "cast(max(case when c_price > 45000000 then 1 else 0 end) as int)",
    "cliente_antiguedad": "cast(max(yr) - 1990 as int)",
    "cliente_edad": "cast(20 + max(cust) % 50 as int)",
    "mrentabilidad": _money("c_disc - c_tax"),
    "mrentabilidad_annual": _money("c_disc"),
    "mcomisiones": _money("c_tax"),
    "mcomisiones_mantenimiento": _money("c_tax_new"),
    "mcomisiones_otras": _money("c_tax_acc"),
    "ccomisiones_mantenimiento": _total("n_new"),
    "mactivos_margen": _money("c_ext_done"),
    "mpasivos_margen": _money("coalesce(c_ext_open, 0) - coalesce(c_ext_done, 0)"),
    "mcuentas_saldo": _money("case when status = 'P' then -c_price else c_price end"),
    "mcaja_ahorro": _money("c_price", "status = 'F'"),
    "mcuenta_corriente": _money("case when mon > 6 then c_price else -c_price end", "status = 'O'"),
    "mautoservicio": _money("c_ret"),
    "cdescubierto_preacordado": _count("status = 'O'"),
    "mpayroll": _money("c_price", "prio = 1"),
    "cpayroll_trx": _count("prio = 1"),
    "mpayroll2": _money("c_price", "prio = 1 and status = 'F'"),
    "cpayroll2_trx": _count("prio = 1 and status = 'F'"),
    "mprestamos_personales": _money("c_price", "prio = 2"),
    "cprestamos_personales": _count("prio = 2"),
    "mprestamos_prendarios": _money("c_price", "prio = 2 and status = 'O'"),
    "mprestamos_hipotecarios": _money("c_price", "prio = 2 and status = 'P'"),
    "mtarjeta_visa_consumo": _money("c_ext", "prio = 3"),
    "ctarjeta_visa_transacciones": _count("prio = 3"),
    "mtarjeta_master_consumo": _money("c_ext", "prio = 4"),
    "ctarjeta_master_transacciones": _count("prio = 4"),
    "ctarjeta_debito_transacciones": _count("prio = 5"),
    "chomebanking_transacciones": _total("n_new"),
    "cmobile_app_trx": _total("n_acc"),
    "ccallcenter_transacciones": _count("prio = 5 and status = 'O'"),
    "ccajas_transacciones": _count("mon <= 2"),
    "ccajas_depositos": _count("mon <= 3"),
    "ccajas_otras": _count("mon between 4 and 6"),
    "matm": _money("c_ret", "mon > 3"),
    "catm_trx": _total("n_ret"),
    "catm_trx_other": _total("n_ret_open"),
    "cpagomiscuentas": _count("mon = 12"),
    "mpagomiscuentas": _money("c_price", "mon = 12"),
    "cpagodeservicios": _count("mon = 11"),
    "mpagodeservicios": _money("c_price", "mon = 11"),
    "ccuenta_debitos_automaticos": _count("mon = 10"),
    "mcuenta_debitos_automaticos": _money("c_price", "mon = 10"),
    "ctarjeta_visa_debitos_automaticos": _count("mon = 10 and prio = 3"),
    "mttarjeta_visa_debitos_automaticos": _money("c_tax", "mon = 10 and prio = 3"),
    "ctarjeta_master_debitos_automaticos": _count("mon = 10 and prio = 4"),
    "mttarjeta_master_debitos_automaticos": _money("c_tax", "mon = 10 and prio = 4"),
    "ctransferencias_emitidas": _count("mon = 9"),
    "mtransferencias_emitidas": _money("c_price", "mon = 9"),
    "mtransferencias_recibidas": _money("c_price", "mon = 8"),
    "ccheques_depositados": _count("mon = 7"),
    "cplazo_fijo": _count("mon = 6"),
    "mplazo_fijo_pesos": _money("c_price", "mon = 6"),
    "mplazo_fijo_dolares": _money("c_disc", "mon = 6"),
    "cinversion1": _count("mon = 5"),
    "minversion1_pesos": _money("c_price", "mon = 5"),
    "minversion1_dolares": _money("c_tax", "mon = 5"),
    "cinversion2": _count("mon = 4"),
    "minversion2": _money("c_price", "mon = 4"),
    "cseguro_vida": _count("mon = 3"),
    "cseguro_auto": _count("mon = 2"),
    "cseguro_vivienda": _count("mon = 1"),
    "cseguro_accidentes_personales": _count("mon = 1 and status = 'F'"),
    "tcallcenter": "cast(max(case when prio = 5 and status = 'O' then 1 else 0 end) as int)",
    **_card("Visa", "3", "P"),
    **_card("Master", "4", "O"),
}

_ORDER_COLUMNS = {
    "cust": "o_custkey",
    "yr": "cast(year(o_orderdate) as int)",
    "mon": "cast(month(o_orderdate) as int)",
    "status": "o_orderstatus",
    "prio": "cast(substr(o_orderpriority, 1, 1) as int)",
    "c_price": "cast(round(o_totalprice * 100) as bigint)",
}


def _list(columns: dict[str, str]) -> str:
    return ",\n    ".join(f"{e} as {n}" for n, e in columns.items())


def _exprs(columns: dict[str, str]) -> list:
    return [F.expr(e).alias(n) for n, e in columns.items()]


#: Amounts of a line item that several measures sum, rounded once a row.
_CENTS = {
    "_ext": "cast(round(l_extendedprice * 100) as bigint)",
    "_disc": "cast(round(l_extendedprice * l_discount * 100) as bigint)",
    "_tax": "cast(round(l_extendedprice * l_tax * 100) as bigint)",
}


def _of_cents(expr: str) -> str:
    for name, amount in _CENTS.items():
        expr = expr.replace(amount, name)
    return expr


def bank_panel(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Customer x year panel with the bank's column names (all of them, or `columns`).

    Line items are summed per order before the join, so an order with very many lines does
    not skew it. Orders are then shuffled by customer, as narrow rows and once: sums, label and
    history windows of a customer all share that shuffle, and the measures are never shuffled.
    """
    measures = BANK_MEASURES if columns is None else {c: BANK_MEASURES[c] for c in columns}
    orders = table(spark, folder, "orders").select("o_orderkey", *_exprs(_ORDER_COLUMNS))
    needed = [c for c in _LINE_MEASURES if any(c in e for e in measures.values())]
    if needed:
        lines = (
            table(spark, folder, "lineitem")
            .select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", *_exprs(_CENTS))
            .groupBy("l_orderkey")
            .agg(*_exprs({c: _of_cents(_LINE_MEASURES[c]) for c in needed}))
        )
        orders = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return (
        orders.withColumn(K.ENTITY, F.col("cust").cast("long")).repartition(K.ENTITY)
        .groupBy(K.ENTITY, order_period(F.col("yr")).alias(K.PERIOD)).agg(*_exprs(measures))
    )


def bank_sql(columns: list[str] | None = None) -> str:
    """CTEs `bank_orders` and `panel` for the check SQL."""
    measures = BANK_MEASURES if columns is None else {c: BANK_MEASURES[c] for c in columns}
    return f"""
with lines as (
  select l_orderkey, {_list(_LINE_MEASURES)} from lineitem group by l_orderkey
),
bank_orders as (
  select o.*, lines.* from (select o_orderkey, {_list(_ORDER_COLUMNS)} from orders) o
  left join lines on o.o_orderkey = lines.l_orderkey
),
panel as (
  select cast(cust as bigint) as {K.ENTITY}, cast(({_MONTHS} + yr) // 12 * 100 + ({_MONTHS} + yr) % 12 + 1 as int) as {K.PERIOD}
    {''.join(', ' + e + ' as ' + n for n, e in measures.items())}
  from bank_orders group by 1, 2
)"""


# --- customer x calendar month, sparse ------------------------------------------------------

def month_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Customer x order month with gaps: order count, spend, largest order."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_custkey").alias(K.ENTITY),
            (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int").alias(K.PERIOD),
        )
        .agg(
            F.count(F.lit(1)).cast("int").alias("cpedidos"),
            (F.sum(cents).cast("double") / F.lit(100.0)).alias("mgasto"),
            (F.max(cents).cast("double") / F.lit(100.0)).alias("mmayor"),
        )
    )


MONTH_SQL = f"""
with panel as (
  select o_custkey as {K.ENTITY}, cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as {K.PERIOD},
         cast(count(*) as int) as cpedidos,
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(100 as double) as mgasto,
         cast(max(cast(round(o_totalprice * 100) as bigint)) as double) / cast(100 as double) as mmayor
  from orders group by 1, 2
)"""


# --- user x day, dense ------------------------------------------------------------------------

# The event types of the driver's table.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def day_panel(spark: SparkSession, folder: str) -> DataFrame:
    """User x day: events and value, in total and per event type (NULL when there was none)."""
    cents = F.round(F.col("value") * 100).cast("long")
    kinds = [
        expr
        for t in EVENT_TYPES
        for expr in (
            F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).cast("int").alias(f"c{t}"),
            (F.sum(F.when(F.col("event_type") == t, cents)).cast("double") / F.lit(100.0)).alias(f"m{t}"),
        )
    ]
    return (
        table(spark, folder, "events")
        .groupBy(
            F.col("user_id").alias(K.ENTITY),
            (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("int").alias(K.PERIOD),
        )
        .agg(
            F.count(F.lit(1)).cast("int").alias("ceventos"),
            (F.sum(cents).cast("double") / F.lit(100.0)).alias("mvalor"),
            *kinds,
        )
    )


DAY_SQL = f"""
with panel as (
  select user_id as {K.ENTITY},
         cast(year(ts) * 10000 + month(ts) * 100 + day(ts) as int) as {K.PERIOD},
         cast(count(*) as int) as ceventos,
         cast(sum(cast(round(value * 100) as bigint)) as double) / cast(100 as double) as mvalor
         {"".join(f''',
         cast(sum(case when event_type = '{t}' then 1 else 0 end) as int) as c{t},
         cast(sum(case when event_type = '{t}' then cast(round(value * 100) as bigint) end) as double)
           / cast(100 as double) as m{t}''' for t in EVENT_TYPES)}
  from events group by 1, 2
)"""
