"""The derived panels: each takes a labelled bank panel and adds a family of features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.scalars import (
    clamped_ratio,
    count_positive,
    flag,
    null_safe_sum,
    positive,
    ratio,
    safe_ratio,
    sure_flag,
    zero,
)
from panelmill.functions.selectors import amount_columns, numeric_predictors, own_amounts, with_suffix
from panelmill.operators import history as H
from panelmill.operators import ranks as R
from panelmill.operators import repair as Q

# Status codes of a card that is closing.
CLOSING = (6, 7, 9)

# Columns whose history enters the mixed panel.
MIXED_FIELDS = (
    "ctrx_quarter", "cproductos", "mrentabilidad", "mrentabilidad_annual", "mcuentas_saldo", "mpayroll",
    "cpayroll_trx", "mcaja_ahorro", "mcuenta_corriente", "mtarjeta_visa_consumo",
    "ctarjeta_visa_transacciones", "mtarjeta_master_consumo", "ctarjeta_master_transacciones",
    "mcomisiones", "mcomisiones_mantenimiento", "ccomisiones_mantenimiento", "matm", "catm_trx",
    "chomebanking_transacciones", "ccallcenter_transacciones", "ccajas_transacciones",
    "mtransferencias_recibidas", "mtransferencias_emitidas", "mpagomiscuentas", "cpagomiscuentas",
    "mprestamos_personales", "cprestamos_personales", "mpasivos_margen", "mactivos_margen",
    "Visa_msaldototal", "Visa_mpagominimo", "Master_msaldototal", "active_quarter", "cliente_antiguedad",
)
# Columns of the own-history panel.
OWN_HISTORY_FIELDS = (
    "ctrx_quarter", "mcuentas_saldo", "mcaja_ahorro", "mpayroll", "cpayroll_trx", "mtarjeta_visa_consumo",
    "ctarjeta_visa_transacciones", "mtarjeta_master_consumo", "chomebanking_transacciones",
    "cmobile_app_trx", "ccajas_transacciones", "catm_trx", "mcomisiones", "mcomisiones_mantenimiento",
    "mactivos_margen", "mpasivos_margen", "cproductos", "mtransferencias_emitidas",
    "mtransferencias_recibidas", "ctarjeta_debito_transacciones",
)
# Columns of the minimal history.
STABLE_FIELDS = ("ctrx_quarter", "mcuentas_saldo", "Visa_status", "Master_status", "cpayroll_trx")
# Amounts watched for transitions, and the block that is NULL together.
TRANSITION_FIELDS = (
    "mcaja_ahorro", "mcuentas_saldo", "mpasivos_margen", "mpayroll", "mcuenta_corriente",
    "mtarjeta_visa_consumo", "mtarjeta_master_consumo", "mprestamos_personales", "mplazo_fijo_pesos",
    "mtransferencias_recibidas", "mcomisiones_mantenimiento", "mrentabilidad",
)
NULL_BLOCK = (
    "mrentabilidad", "mrentabilidad_annual", "mcomisiones", "mactivos_margen", "mpasivos_margen",
    "mcuenta_corriente", "mcaja_ahorro", "mcuentas_saldo", "mautoservicio", "mtarjeta_visa_consumo",
    "mtarjeta_master_consumo", "mpayroll", "mcomisiones_mantenimiento", "mcomisiones_otras",
)
# Contact channels, counters that mark an active product, insurances, growth columns.
CHANNELS = (
    "chomebanking_transacciones", "cmobile_app_trx", "ccallcenter_transacciones", "catm_trx",
    "catm_trx_other", "ccajas_transacciones",
)
PRODUCTS = (
    "ctarjeta_visa_transacciones", "ctarjeta_master_transacciones", "cprestamos_personales", "cplazo_fijo",
    "cinversion1", "cinversion2", "cseguro_vida", "cseguro_auto", "cseguro_vivienda",
    "cseguro_accidentes_personales", "cpayroll_trx", "ccuenta_debitos_automaticos",
    "ctransferencias_emitidas", "ccheques_depositados",
)
INSURANCES = ("cseguro_vida", "cseguro_auto", "cseguro_vivienda", "cseguro_accidentes_personales")
GROWTH_FIELDS = (
    "mcuentas_saldo", "mpayroll", "ctrx_quarter", "mprestamos_personales", "mcaja_ahorro", "mrentabilidad",
    "mcomisiones", "Visa_msaldototal",
)
# What is added up into each total.
LOANS = ("mprestamos_personales", "mprestamos_prendarios", "mprestamos_hipotecarios")
CARD_DEBT = ("Visa_msaldototal", "Master_msaldototal")
INVESTMENTS = (
    "mplazo_fijo_dolares", "mplazo_fijo_pesos", "minversion1_pesos", "minversion1_dolares", "minversion2",
)
FEES = ("mcomisiones_mantenimiento", "mcomisiones")
BONUS_FIELDS = ("mpayroll", "mpayroll2", "cpayroll_trx")
BAD_DEPOSITS, BONUS_PERIOD, INJECTED_PERIODS = (202105,), 202106, (202105, 202108)


def _without_look_ahead(panel: DataFrame) -> DataFrame:
    return panel.drop(*K.LOOK_AHEAD)


def full_history(panel: DataFrame, columns: Sequence[str] | None = None, dead_periods: Sequence[int] = BAD_DEPOSITS,
                 lags_of_raw: bool = False) -> DataFrame:
    """lag1, delta1, lag2, delta2 of all numeric predictors, in one window.

    `ccajas_depositos` is dead in `dead_periods` and nulled there first. With `lags_of_raw`
    only the current value is nulled and the lags still see the raw column.
    """
    columns = numeric_predictors(panel) if columns is None else list(columns)
    if "ccajas_depositos" not in columns:
        return H.add(panel, H.lag_block(columns))
    cleaned = Q.null_in_periods("ccajas_depositos", dead_periods)
    if lags_of_raw:
        return H.add(panel, H.lag_block(columns)).withColumn("ccajas_depositos", cleaned)
    return H.add(panel.withColumn("ccajas_depositos", cleaned), H.lag_block(columns))


def mixed_features(panel: DataFrame, fields: Sequence[str] = MIXED_FIELDS) -> DataFrame:
    """lag1, delta1 and slope of the behaviour columns, percent rank of every amount."""
    base = _without_look_ahead(panel)
    fields = [c for c in fields if c in base.columns]
    ranked = R.period_ranks(base, own_amounts(base.columns))
    return H.add(ranked, H.lags(fields), H.deltas(fields), H.slopes(fields))


def risk_flags(panel: DataFrame) -> DataFrame:
    """First set of hypothesis flags: red balance, anchors, silence, closing cards."""
    red = F.col("mcuentas_saldo") < 0
    paid = zero("cpayroll_trx") + zero("cpayroll2_trx") > 0
    bills = zero("cpagomiscuentas") > 0
    silent = zero("ctrx_quarter") == 0
    return _without_look_ahead(panel).withColumns({
        "v_rojo": flag(red),
        "v_meses_en_rojo": H.running_count(red),
        "v_rojo_sin_acuerdo": flag(red & (zero("cdescubierto_preacordado") == 0)),
        "v_rojo_intensidad": safe_ratio("mcuentas_saldo", F.abs("mcuentas_saldo") + 1),
        "v_cobra_sueldo": flag(paid),
        "v_domicilia": flag(bills),
        "v_anclas": flag(paid) + flag(bills),
        "v_meses_sin_trx": H.running_count(silent),
        "v_ctrx_minimo": F.min(zero("ctrx_quarter")).over(H.all_rows()),
        "v_ctrx_delta": F.col("ctrx_quarter") - F.lag("ctrx_quarter", 1).over(H.history()),
        "v_usa_cajero": flag(zero("catm_trx") + zero("catm_trx_other") > 0),
        "v_tc_cerrando": flag(F.greatest(zero("Visa_status"), zero("Master_status")).isin(*CLOSING)),
        "v_tc_mora": F.greatest(zero("Visa_delinquency"), zero("Master_delinquency")),
        "v_tc_saldo": null_safe_sum("Visa_msaldototal", "Master_msaldototal"),
    })


def _late(card: str) -> Column:
    """Delinquent, and not by an injected zero in the start of the delay."""
    return flag(
        (zero(f"{card}_delinquency") == 1) & (F.coalesce(F.col(f"{card}_Finiciomora"), F.lit(1)) > 0)
    )


def risk_flags_fixed_windows(panel: DataFrame, first_row_fires: bool = True) -> DataFrame:
    """Second set of flags, on windows of fixed length.

    The two onset flags take 1 and 0 for a missing previous value, so they can fire on an
    entity's first row; `first_row_fires=False` leaves them NULL there.
    """
    base = _without_look_ahead(panel).withColumns({
        "_canales": null_safe_sum(*CHANNELS, "ctarjeta_debito_transacciones"),
        "_status": F.greatest(zero("Visa_status"), zero("Master_status")),
        "_sueldo": null_safe_sum("cpayroll_trx", "cpayroll2_trx"),
        "_debitos": null_safe_sum(
            "ccuenta_debitos_automaticos", "ctarjeta_visa_debitos_automaticos", "ctarjeta_master_debitos_automaticos"
        ),
        "_servicios": null_safe_sum("cpagodeservicios", "cpagomiscuentas"),
    })
    three, two_before, h = H.last_rows(3), H.previous_rows(2), H.history()
    red, trx, status = F.col("mcuentas_saldo") < 0, F.col("ctrx_quarter"), F.col("_status")
    if first_row_fires:
        to_zero = flag((trx == 0) & (F.coalesce(F.lag(trx, 1).over(h), F.lit(1)) > 0))
        closes = flag((status >= 6) & (F.coalesce(F.lag(status, 1).over(h), F.lit(0)) == 0))
    else:
        to_zero = H.onset(trx == 0, lambda w: F.lag(trx, 1).over(w) > 0)
        closes = H.onset(status >= 6, lambda w: F.lag(status, 1).over(w) == 0)
    flags = base.withColumns({
        "w_rojo": flag(red),
        "w_rojo_sin_acuerdo": flag(red & (zero("cdescubierto_preacordado") == 0)),
        "w_rojo_3m": F.sum(flag(red)).over(three),
        "w_canales_mes": F.col("_canales"),
        "w_canales_cero_3m": F.sum(flag(F.col("_canales") == 0)).over(three),
        "w_ctrx_cae_a_cero": to_zero,
        "w_aq1_ctrx0": flag((F.col("active_quarter") == 1) & (trx == 0)),
        "w_ctrx_cae_fuerte": flag(trx < 0.6 * F.nullif(F.max(trx).over(two_before), F.lit(0))),
        "w_ctrx_min_3m": F.min(trx).over(three),
        "w_tc_cerrando": flag(status.isin(*CLOSING)),
        "w_tc_cierre_nuevo": closes,
        "w_mora_vieja": _late("Visa") + _late("Master"),
        "w_tc_saldo": null_safe_sum(*CARD_DEBT),
        "w_cobra_sueldo": flag(F.col("_sueldo") > 0),
        "w_anclas": positive("_sueldo") + positive("_debitos") + positive("_servicios"),
        "w_usa_cajero": flag(null_safe_sum("catm_trx", "catm_trx_other") > 0),
    }).drop("_canales", "_status", "_sueldo", "_debitos", "_servicios")
    fee = safe_ratio("mcomisiones_mantenimiento", "ctrx_quarter")
    return R.expression_rank(flags, "w_fee_por_trx_rk", fee)


def product_loss(panel: DataFrame) -> DataFrame:
    return H.loss_features(_without_look_ahead(panel))


def deflated(panel: DataFrame) -> DataFrame:
    """Every own amount over the period median of its positive values."""
    base = _without_look_ahead(panel)
    return R.deflate(base, own_amounts(base.columns))


def own_history(panel: DataFrame, fields: Sequence[str] = OWN_HISTORY_FIELDS) -> DataFrame:
    base = _without_look_ahead(panel)
    return H.add(base, H.own_history([c for c in fields if c in base.columns]))


def combined(panel: DataFrame, dropped: Sequence[str] = ("mprestamos_personales", "cprestamos_personales")) -> DataFrame:
    """Own history plus deflated amounts in place of raw ones, without one product family."""
    base = own_history(panel)
    raw = own_amounts(base.columns)
    kept = [c for c in raw if c not in dropped]
    return R.deflate(base, kept).drop(*raw, *dropped)


def ranked_history(panel: DataFrame) -> DataFrame:
    """Amounts become their percent rank in the month (NULL stays NULL), then history of all predictors."""
    columns = numeric_predictors(panel)
    cleaned = panel
    if "ccajas_depositos" in columns:
        cleaned = panel.withColumn("ccajas_depositos", Q.null_in_periods("ccajas_depositos", BAD_DEPOSITS))
    ranked = R.period_ranks(cleaned, amount_columns(columns), nulls="keep", replace=True)
    return H.add(ranked, H.lag_block(columns))


def repaired_transitions(panel: DataFrame) -> DataFrame:
    """Repaired columns, transitions of the main amounts, recency of four events, history."""
    columns = numeric_predictors(panel)
    out = with_suffix(columns, "_mconsumototal")
    repaired = panel.drop(*out).withColumns({
        "ccajas_depositos": Q.null_in_periods("ccajas_depositos", BAD_DEPOSITS),
        "ccajas_dep_otras": Q.merged(Q.null_in_periods("ccajas_depositos", BAD_DEPOSITS), "ccajas_otras"),
        **{f"{c}_Fvencimiento": Q.sentinel_to_null(f"{c}_Fvencimiento", -1_000_000) for c in ("Visa", "Master")},
        **{
            f"{c}_mfinanciacion_limite": Q.outlier_to_null(f"{c}_mfinanciacion_limite", f"{c}_mlimitecompra", 10)
            for c in ("Visa", "Master")
        },
        "bloque_nulo": Q.null_block_flag(NULL_BLOCK),
    })
    events = {
        "sueldo": zero("cpayroll_trx") > 0,
        "trx": zero("ctrx_quarter") > 0,
        "saldo_pos": zero("mcuentas_saldo") > 0,
        "consumo_tc": null_safe_sum("mtarjeta_visa_consumo", "mtarjeta_master_consumo") > 0,
    }
    with_history = [c for c in columns if c not in out] + ["ccajas_dep_otras", "bloque_nulo"]
    return H.add(
        repaired,
        H.transitions(TRANSITION_FIELDS),
        {f"rec_{n}": H.recency(c) for n, c in events.items()},
        H.lag_block(with_history),
    )


def deflated_fees(panel: DataFrame, columns: Sequence[str] = FEES) -> DataFrame:
    """Fees over the month's median fee in place of the raw fees, and their history."""
    joined = R.with_medians(panel, columns)
    repaired = Q.repaired_in_place(joined, {c: ratio(c, f"{c}__d") for c in columns})
    return H.add(repaired.drop(*[f"{c}__d" for c in columns]), H.lag_block(columns))


def without_bonus(panel: DataFrame, columns: Sequence[str] = BONUS_FIELDS) -> DataFrame:
    """The half-yearly bonus taken out of June where there is evidence of it, and history."""
    evidence = Q.bonus_month(BONUS_PERIOD, "mpayroll", "cpayroll_trx")
    repairs = {c: Q.without_bonus(c, evidence, c.startswith("c")) for c in columns}
    return H.add(Q.repaired_in_place(panel, repairs), H.lag_block(columns))


def calendar_repaired(panel: DataFrame) -> DataFrame:
    """VIP flag carried over its bad month, injected delinquency zeroed, and their history."""
    repairs = {
        "cliente_vip": Q.carried("cliente_vip", BONUS_PERIOD),
        "Visa_delinquency": Q.zero_where_injected("Visa_delinquency", "Visa_Finiciomora", INJECTED_PERIODS),
    }
    return H.add(Q.repaired_in_place(panel, repairs), H.lag_block(list(repairs)))


def _shares() -> dict[str, Column]:
    limit = null_safe_sum("Visa_mlimitecompra", "Master_mlimitecompra")
    return {
        "p_util_visa": ratio("Visa_msaldototal", "Visa_mlimitecompra"),
        "p_util_master": ratio("Master_msaldototal", "Master_mlimitecompra"),
        "p_util_total": ratio(null_safe_sum(*CARD_DEBT), limit),
        "p_consumo_limite": ratio(null_safe_sum("mtarjeta_visa_consumo", "mtarjeta_master_consumo"), limit),
        "p_saldo_sueldo": ratio("mcuentas_saldo", "mpayroll"),
        "p_prestamo_sueldo": ratio("mprestamos_personales", "mpayroll"),
        "p_consumo_sueldo": ratio("Visa_mconsumototal", "mpayroll"),
        "p_pago_saldo_visa": clamped_ratio("Visa_mpagado", "Visa_msaldototal"),
        "p_minimo_saldo_visa": clamped_ratio("Visa_mpagominimo", "Visa_msaldototal"),
        "p_ahorro_share": ratio("mcaja_ahorro", F.abs("mcaja_ahorro") + F.abs("mcuenta_corriente")),
        "p_trx_producto": ratio("ctrx_quarter", "cproductos"),
    }


def business_shares(panel: DataFrame) -> DataFrame:
    """Eleven ratios between products, as 4-byte floats, and their history."""
    shares = {n: e.cast("float") for n, e in _shares().items()}
    return H.add(panel.withColumns(shares), H.lag_block(list(shares)))


def _totals() -> dict[str, Column]:
    debt = null_safe_sum(*LOANS, *CARD_DEBT)
    return {
        "s_saldo_tarjetas": null_safe_sum(*CARD_DEBT),
        "s_limite_tarjetas": null_safe_sum("Visa_mlimitecompra", "Master_mlimitecompra"),
        "s_consumo_tarjetas": null_safe_sum("mtarjeta_visa_consumo", "mtarjeta_master_consumo"),
        "s_prestamos": null_safe_sum(*LOANS),
        "s_deuda_total": debt,
        "s_ingresos": null_safe_sum("mpayroll", "mpayroll2"),
        "s_inversiones": null_safe_sum(*INVESTMENTS),
        "s_patrimonio": null_safe_sum("mcuentas_saldo", *INVESTMENTS) - debt,
        "s_debitos_auto": null_safe_sum(
            "mcuenta_debitos_automaticos", "mttarjeta_visa_debitos_automaticos", "mttarjeta_master_debitos_automaticos"
        ),
        "s_pagos_servicios": null_safe_sum("mpagodeservicios", "mpagomiscuentas"),
    }


def _counts() -> dict[str, Column]:
    return {
        "n_canales": count_positive(*CHANNELS),
        "n_productos_activos": count_positive(*PRODUCTS),
        "n_seguros": null_safe_sum(*INSURANCES),
        "n_tarjetas_cierre": sure_flag(F.col("Visa_status").isin(*CLOSING))
        + sure_flag(F.col("Master_status").isin(*CLOSING)),
        "n_trx_canales": null_safe_sum(*CHANNELS),
    }


def _bad_months() -> dict[str, Column]:
    balance = F.col("mcuentas_saldo")
    return {
        "r_rojo": zero("mcuentas_saldo") < 0,
        "r_sin_sueldo": zero("cpayroll_trx") == 0,
        "r_sin_consumo": null_safe_sum("mtarjeta_visa_consumo", "mtarjeta_master_consumo") == 0,
        "r_sin_operar": null_safe_sum(*CHANNELS) == 0,
        "r_cae_saldo": balance < F.lag(balance, 1).over(H.history()),
    }


def sums_and_streaks(panel: DataFrame) -> DataFrame:
    """Totals, counts, streaks of bad months, growth, and history of totals and counts."""
    sums = {n: e.cast("float") for n, e in {**_totals(), **_counts()}.items()}
    held = {f"{n}__c": sure_flag(c) for n, c in _bad_months().items()}
    grown = {n: e.cast("float") for n, e in H.growth(GROWTH_FIELDS).items()}
    first = H.add(panel, sums, held, grown)
    streaks = {n: H.streak(f"{n}__c") for n in _bad_months()}
    return H.add(first, streaks, H.lag_block(list(sums))).drop(*held)
