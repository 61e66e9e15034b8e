"""Queries for targets, weights, folds, splits, and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators import drift as D
from panelmill.operators import targets as T
from panelmill.operators.ranking import top_k
from panelmill.plans.base import E, L, P, labelled, labelled_sql
from panelmill.plans.panels import BANK_MEASURES
from panelmill.plans.registry import query
from panelmill.plans.scores import uniform_sql
from panelmill.session import checkpoint

_X = ["ctrx_quarter", "mcuentas_saldo"]
_TRAIN = (202103, 202104, 202105)


def _rows(spark, folder, columns=_X):
    return labelled(spark, folder, columns)


_IN_TRAIN = f"{P} in (202103, 202104, 202105)"


@query(
    "training_targets", "TG1",
    labelled_sql(_X) + " union all ".join(
        f" select *, '{k}' as objetivo, cast(case when {L} in ({c}) then 1 else 0 end as int) as clase_binaria,"
        f" {w} as peso from labelled where {_IN_TRAIN}"
        for k, c, w in (
            ("baja1", "'BAJA+1'", "1.0::double"), ("baja2", "'BAJA+2'", "1.0::double"),
            ("baja12", "'BAJA+1', 'BAJA+2'", "1.0::double"),
            ("pesos", "'BAJA+1', 'BAJA+2'", f"case when {L} = 'BAJA+1' then 0.25::double else 1 end"),
        )),
)
def training_targets(spark, folder):
    panel = _rows(spark, folder)
    parts = [
        T.prepare(panel, _TRAIN, k, 0.25).withColumn("objetivo", F.lit(k)) for k in ("baja1", "baja2", "baja12", "pesos")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "decayed_weights", "TG2 PR15",
    labelled_sql(_X) + f""" select *, cast(case when {L} in ('BAJA+1', 'BAJA+2') then 1 else 0 end as int) as clase_binaria,
      pow(0.5::double, 202105 - {P}) * case when {L} = 'BAJA+1' then 0.25::double else 1 end as peso from labelled where {_IN_TRAIN}""",
)
def decayed_weights(spark, folder):
    return T.decayed(T.prepare(_rows(spark, folder), _TRAIN, "pesos", 0.25), 0.5, 202105)


@query(
    "matched_positives", "TG3",
    labelled_sql(_X) + f""", m as (select *, row_number() over (partition by coalesce({L}, '') order by {uniform_sql(E, P, "7")}, {E}) as rn
      from labelled where {P} = 202104)
    select * exclude (rn) from m where {L} is distinct from 'BAJA+2'
      or rn <= (select count(*) from labelled where {P} = 202103 and {L} = 'BAJA+2')""",
)
def matched_positives(spark, folder):
    return T.match_positives(_rows(spark, folder), 202104, 202103, seed=7)


@query(
    "partially_labelled_training", "TG4",
    labelled_sql(_X) + f""" select *,
      cast(case when {P} = 202105 and {L} = 'BAJA+2' then 0 when {L} in ('BAJA+1', 'BAJA+2') then 1 else 0 end as int) as clase_binaria,
      case when {L} = 'BAJA+1' then 0.25::double else 1 end as peso from labelled where {_IN_TRAIN}""",
)
def partially_labelled_training(spark, folder):
    return T.partially_labelled(_rows(spark, folder), (202103, 202104), 202105)


@query(
    "unlabelled_month_appended", "TG5 ST5 JN11",
    labelled_sql(_X) + f""",
    sos as (select {E} from labelled where {P} = 202107 order by mcuentas_saldo desc, {E} limit 200)
    select *, cast(case when {L} in ('BAJA+1', 'BAJA+2') then 1 else 0 end as int) as clase_binaria,
      case when {L} = 'BAJA+1' then 0.25::double else 1 end as peso from labelled where {_IN_TRAIN}
    union all
    select *, cast(coalesce({L} = 'BAJA+1', false) as int), case when {L} = 'BAJA+1' then 0.5::double else 1 end from labelled
    where {P} = 202107 and ({L} = 'BAJA+1' or {E} not in (select {E} from sos))""",
)
def unlabelled_month_appended(spark, folder):
    panel = _rows(spark, folder)
    month = panel.filter(F.col(P) == 202107)
    suspects = top_k(month.withColumn("score", F.col("mcuentas_saldo")), 200)
    return T.append_unlabelled(T.prepare(panel, _TRAIN, "pesos", 0.25), month, suspects, 0.5)


FOLDS = (
    T.Fold("A", (202103,), 202105),
    T.Fold("B", (202103, 202104), 202106),
    T.Fold("C", (202103, 202104, 202105), 202107, K.LEAVES_NEXT),
)


@query(
    "walk_forward_folds", "TG6",
    labelled_sql(_X) + f""", f as (select * from (values ('A', 'entrenamiento', 202103, 'BAJA+2'), ('A', 'validacion', 202105, 'BAJA+2'),
      ('B', 'entrenamiento', 202103, 'BAJA+2'), ('B', 'entrenamiento', 202104, 'BAJA+2'), ('B', 'validacion', 202106, 'BAJA+2'),
      ('C', 'entrenamiento', 202103, 'BAJA+1'), ('C', 'entrenamiento', 202104, 'BAJA+1'), ('C', 'entrenamiento', 202105, 'BAJA+1'),
      ('C', 'validacion', 202107, 'BAJA+1')) t(fold, rol, p, positiva))
    select l.*, fold, rol, cast(coalesce({L} = positiva, false) as int) as clase_binaria from labelled l join f on f.p = l.{P}""",
)
def walk_forward_folds(spark, folder):
    return T.assign_folds(_rows(spark, folder), FOLDS)


_LINKS = (((202103,), 202104), ((202103, 202104), 202105), ((202103, 202104, 202105), 202106))


@query(
    "positive_leak_audit", "TG7",
    labelled_sql(_X) + " union all ".join(
        f""" select cast({v} as int) as validacion, count(*) as positivos,
          sum(case when {E} in (select {E} from labelled where {L} = 'BAJA+2' and {P} in ({", ".join(map(str, ps))})) then 1 else 0 end)::bigint as ya_en_entrenamiento,
          avg(case when {E} in (select {E} from labelled where {L} = 'BAJA+2' and {P} in ({", ".join(map(str, ps))})) then 1 else 0 end) as fraccion
        from labelled where {L} = 'BAJA+1' and {P} = {v}""" for ps, v in _LINKS),
)
def positive_leak_audit(spark, folder):
    return T.leak_audit(_rows(spark, folder), _LINKS)


@query(
    "entity_split", "TG8",
    labelled_sql(_X) + f""" select l.*, s.semilla, {uniform_sql(E, 'semilla')} < 0.3 as es_test
    from labelled l cross join (select cast(unnest([261431, 269281]) as int) as semilla) s""",
)
def entity_split(spark, folder):
    return T.group_split(_rows(spark, folder), K.SEEDS[:2])


@query(
    "row_split_stratified", "TG9",
    labelled_sql(_X) + f""", u as (select *, row_number() over (partition by {L} order by {uniform_sql(E, P, '11')}, {E}, {P}) as rn,
      count(*) over (partition by {L}) as n from labelled where {L} is not null)
    select * exclude (rn, n), rn <= round_even(n * 0.3::double, 0) as es_test from u""",
)
def row_split_stratified(spark, folder):
    return T.row_split(_rows(spark, folder), seed=11)


@query(
    "two_stage_targets", "TG10",
    labelled_sql(_X) + f""" select *, cast({L} in ('BAJA+1', 'BAJA+2') as int) as se_va,
      case when {L} in ('BAJA+1', 'BAJA+2') then cast({L} = 'BAJA+2' as int) end as en_dos from labelled where {L} is not null""",
)
def two_stage_targets(spark, folder):
    return T.two_stage(_rows(spark, folder))


@query(
    "canary_columns", "TG11",
    labelled_sql(_X) + f" select *, {uniform_sql(E, P, '100')} as ruido0000, {uniform_sql(E, P, '101')} as ruido0001 from labelled",
)
def canary_columns(spark, folder):
    return T.with_canaries(_rows(spark, folder), n_predictors=10, seed=100)


# --- drift ------------------------------------------------------------------------------------

_COLS = list(BANK_MEASURES)
_LONG = labelled_sql(_COLS) + ", largo as (" + " union all ".join(
    f"select {P}, coalesce({L} = 'BAJA+2', false)::int as y, '{c}' as feature, cast({c} as double) as value from labelled" for c in _COLS
) + ")"


def _auc_sql(group: str, order: str, source: str) -> str:
    return f"""select {group}, (sum(case when y = 1 then rk else 0 end) - sum(y) * (sum(y) + 1.0::double) / 2)
      / nullif(sum(y)::double * (count(*) - sum(y)), 0) as auc
      from (select *, rank() over (partition by {group} order by {order}) + (count(*) over (partition by {group}, value) - 1) / 2.0::double as rk
        from {source}) group by {group}"""


@query(
    "univariate_auc", "ML10",
    _LONG + f""", a as ({_auc_sql('feature', 'value nulls first', f'(select * from largo where {P} between 202103 and 202106)')})
    select feature, round(auc, 9) as auc, round(abs(auc - 0.5), 9) as distancia, case when auc < 0.5 then 'menos' else 'mas' end as direccion from a""",
)
def univariate_auc(spark, folder):
    panel = _rows(spark, folder, _COLS).filter(F.col(P).between(202103, 202106))
    aucs = D.signal(D.univariate_auc(panel, _COLS, by_period=False))
    return aucs.withColumns({"auc": F.round("auc", 9), "distancia": F.round("distancia", 9)})


@query(
    "univariate_auc_per_period", "ML10",
    _LONG + f""", a as ({_auc_sql(f'{P}, feature', 'value nulls last', f'(select * from largo where {P} between 202103 and 202106)')})
    select {P}, feature, round(auc, 9) as auc from a""",
)
def univariate_auc_per_period(spark, folder):
    panel = _rows(spark, folder, _COLS).filter(F.col(P).between(202103, 202106))
    return D.univariate_auc(panel, _COLS, nulls="top").withColumn("auc", F.round("auc", 9))


_PSI = f""", e as (select feature, list_sort(list_distinct(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as q
      from largo where {P} = 202103 and value is not null group by 1),
    b as (select l.feature, {P}, least(len(list_filter(q, lambda z: z <= value)), len(q) - 1) as bin from largo l join e using (feature)
      where {P} in (202103, 202106) and value is not null and len(q) >= 3 and value between q[1] and q[-1]),
    c as (select feature, bin, sum(case when {P} = 202106 then 1 else 0 end) as a, sum(case when {P} = 202103 then 1 else 0 end) as r from b group by 1, 2),
    s as (select feature, a / greatest(sum(a) over w, 1) + 1e-10 as a, r / greatest(sum(r) over w, 1) + 1e-10 as r from c window w as (partition by feature)),
    p as (select e.feature, sum((a - r) * ln(a / r)) as psi from e left join s using (feature) group by 1)"""


@query("stability_index", "ML11 AG16", _LONG + _PSI + " select feature, round(psi, 8) as psi from p")
def stability_index(spark, folder):
    # the label plays no part here: without it no window needs the other periods, and only the two compared are built
    panel = _rows(spark, folder, _COLS).select(P, *_COLS)
    return D.psi(panel, _COLS, 202103, 202106).withColumn("psi", F.round("psi", 8))


_DRIFT = [f"auc_{m}" for m in ("03", "04", "05", "06")]


@query(
    "concept_drift_screen", "ML12 ML10 ML11 ST3",
    _LONG + _PSI + f""", a as ({_auc_sql(f'{P}, feature', 'value nulls last', f'(select * from largo where {P} between 202103 and 202106)')}),
    t as (select feature, {", ".join(f"max(case when {P} = 2021{m} then auc end) as auc_{m}" for m in ("03", "04", "05", "06"))},
      max(auc) - min(auc) as rango_auc, max(abs(auc - 0.5)) as senal_max from a group by 1 having count(auc) = 4)
    select feature, {", ".join(f"round({c}, 8) as {c}" for c in _DRIFT)}, round(rango_auc, 8) as rango_auc, round(auc_06 - auc_03, 8) as deriva,
      round(senal_max, 8) as senal_max, round(psi, 8) as psi, coalesce(psi < 0.1 and senal_max > 0.02, false) as candidata
    from t join p using (feature)""",
)
def concept_drift_screen(spark, folder):
    panel = checkpoint(_rows(spark, folder, _COLS))
    table = D.concept_drift(panel, _COLS, (202103, 202104, 202105, 202106))
    numbers = [*_DRIFT, "rango_auc", "deriva", "senal_max", "psi"]
    return table.withColumns({c: F.round(c, 8) for c in numbers}).orderBy(F.desc("rango_auc"), "feature")


#: Correlation from which two columns say the same.
_ALIKE = 0.95
_CORRELATIONS = "z as (select " + ", ".join(f"coalesce(cast({c} as double), 0) as {c}" for c in _COLS) + """ from labelled),
  p as (select unnest([""" + ", ".join(
    f"{{'a': '{a}', 'b': '{b}', 'r': corr({a}, {b})}}" for i, a in enumerate(_COLS) for b in _COLS[i + 1:]) + "], recursive := true) from z)"


@query("correlated_columns", "ML9", labelled_sql(_COLS) + f", {_CORRELATIONS} select a, b, round(r, 6) as r from p where abs(r) >= {_ALIKE}")
def correlated_columns(spark, folder):
    return D.correlated_pairs(_rows(spark, folder, _COLS), _COLS, _ALIKE).withColumn("r", F.round("r", 6))


@query(
    "columns_to_drop", "ML9 ML19",
    _LONG + f""", auc as ({_auc_sql('feature', 'value nulls first', 'largo')}), i as (select feature, abs(auc - 0.5) as imp from auc),
    {_CORRELATIONS} select distinct case when x.imp >= y.imp then p.b else p.a end as feature from p
    join i x on x.feature = p.a join i y on y.feature = p.b where abs(r) >= {_ALIKE}""",
)
def columns_to_drop(spark, folder):
    """One column of each correlated pair: the one that separates the classes less."""
    panel = checkpoint(_rows(spark, folder, _COLS))
    aucs = D.signal(D.univariate_auc(panel, _COLS, by_period=False))
    importance = aucs.select("feature", F.col("distancia").alias("importancia"))
    return D.drop_correlated(D.correlated_pairs(panel, _COLS, _ALIKE), importance)
