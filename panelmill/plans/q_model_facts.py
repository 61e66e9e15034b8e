"""What SQL can state exactly about the model queries: rows, entities, folds, targets, ranges and totals.

The scores themselves depend on the learner. These queries run the same jobs and report facts that come out wrong if a
join, a fold or a target does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators import models as M
from panelmill.operators import ranking as R
from panelmill.operators import targets as T
from panelmill.operators.forest import forest_scores
from panelmill.plans import q_models as Q
from panelmill.operators.label import churn_label
from panelmill.plans.base import E, L, P, labelled, labelled_sql
from panelmill.plans.panels import bank_panel, bank_sql
from panelmill.plans.registry import QUERIES, query
from panelmill.session import checkpoint
from panelmill.sources import files

_PANEL = labelled_sql(Q.COLUMNS)
_N = len(Q.WITH_HISTORY)
_K = 300


def _job(name, spark, folder):
    return QUERIES[name].job(spark, folder)


def _in(column, low, high):
    return F.count_if(F.col(column).between(low, high))


def _month(period: int) -> str:
    return f"(select * from labelled where {P} = {period})"


@query(
    "model_scores_facts", "ML1 ML2",
    _PANEL + f""" select cast(unnest([{", ".join(map(str, Q.SEEDS))}]) as int) as modelo, count(*) as filas, count(distinct {E}) as clientes,
      count(*) as dentro from {_month(202106)}""",
)
def model_scores_facts(spark, folder):
    return _job("model_scores_by_seed", spark, folder).groupBy("modelo").agg(
        F.count(F.lit(1)).alias("filas"), F.count_distinct(E).alias("clientes"), _in("score", 0, 1).alias("dentro")
    )


@query(
    "model_training_facts", "ML1 TG1 TG2",
    _PANEL + f""" select {P}, count(*) as filas, sum(case when {L} in ('BAJA+1', 'BAJA+2') then 1 else 0 end)::bigint as positivos,
      sum(case when {L} = 'BAJA+1' then 0.25::double else 1 end) as peso from labelled where {P} in (202103, 202104) group by 1""",
)
def model_training_facts(spark, folder):
    """The training rows that every model query starts from: rows, positives and weight per month."""
    train = Q._train(Q._data(spark, folder))
    return train.groupBy(P).agg(F.count(F.lit(1)).alias("filas"), F.sum(T.Y).alias("positivos"), F.sum(T.WEIGHT).alias("peso"))


@query(
    "model_ensemble_facts", "ML16 EN1",
    _PANEL + f""" select count(*) as filas, count(distinct {E}) as clientes, sum(case when {L} = 'BAJA+2' then 1 else 0 end)::bigint as positivos,
      count(*) as dentro, round((count(*) + 1) / 2.0::double / count(*), 9) as media from {_month(202106)}""",
)
def model_ensemble_facts(spark, folder):
    """Fractional ranks average (n + 1) / 2n in every model, so they do in the ensemble."""
    return _job("model_rank_ensemble", spark, folder).agg(
        F.count(F.lit(1)).alias("filas"), F.count_distinct(E).alias("clientes"), F.sum("positivo").alias("positivos"),
        _in("score", 0, 1).alias("dentro"), F.round(F.avg("score"), 9).alias("media"),
    )


@query(
    "monthly_models_facts", "ML3",
    _PANEL + f" select count(*) as filas, count(distinct {E}) as clientes, count(*) as dentro from {_month(202106)}",
)
def monthly_models_facts(spark, folder):
    return _job("one_model_per_month", spark, folder).agg(
        F.count(F.lit(1)).alias("filas"), F.count_distinct(E).alias("clientes"), _in("score", 0, 1).alias("dentro")
    )


@query(
    "two_stage_facts", "ML4 TG10",
    _PANEL + f""" select count(*) as filas, count(*) as es_producto, count(*) as dentro,
      (select count(*) from labelled where {P} in (202103, 202104) and {L} is not null) as entrena,
      (select count(*) from labelled where {P} in (202103, 202104) and {L} in ('BAJA+1', 'BAJA+2')) as entrena_segunda,
      (select count(*) from labelled where {P} in (202103, 202104) and {L} = 'BAJA+2') as en_dos from {_month(202106)}""",
)
def two_stage_facts(spark, folder):
    scored = _job("two_stage_scores", spark, folder)
    staged = T.two_stage(labelled(spark, folder, Q.COLUMNS).filter(F.col(P).isin(202103, 202104))).agg(
        F.count("se_va").alias("entrena"), F.sum("se_va").alias("entrena_segunda"), F.sum("en_dos").alias("en_dos")
    )
    product = F.abs(F.col("score") - F.col("p_se_va") * F.col("p_en_dos")) < 1e-12
    facts = scored.agg(F.count(F.lit(1)).alias("filas"), F.count_if(product).alias("es_producto"), _in("score", 0, 1).alias("dentro"))
    return facts.select("*", *[staged.select(c).scalar().alias(c) for c in staged.columns])


@query(
    "importance_facts", "ML5 ML6 ML19",
    f"select {_N}::bigint as columnas, {_N}::bigint as puestos, 100.0::double as suma, 100.0::double as acumulado, 0::bigint as al_reves",
)
def importance_facts(spark, folder):
    """One row and one position per column, shares that add up to 100, gains that never rise along the table."""
    table = _job("feature_importance", spark, folder)
    later = table.select((F.col("pos") - 1).alias("pos"), F.col("gain").alias("_next"))
    return table.join(later, "pos", "left").agg(
        F.count(F.lit(1)).alias("columnas"), F.count_distinct("pos").alias("puestos"), F.round(F.sum("gain_pct"), 6).alias("suma"),
        F.round(F.max("gain_acum"), 6).alias("acumulado"), F.count_if(F.col("_next") > F.col("gain")).alias("al_reves"),
    )


@query(
    "importance_type_facts", "ML6",
    f"select unnest(['cruda', 'lag1', 'delta1']) as tipo, {len(Q.COLUMNS)}::bigint as n, true as posible",
)
def importance_type_facts(spark, folder):
    possible = F.col("usadas").between(0, F.col("n")) & F.col("gain_pct").between(0, 100 + 1e-9)
    return _job("importance_by_type", spark, folder).select("tipo", "n", possible.alias("posible"))


@query(
    "importance_set_facts", "ML19",
    f"select {_N}::bigint as columnas, {len(Q.COLUMNS)}::bigint as familias, {_N - 9}::bigint as fuera, 0::bigint as contradicciones",
)
def importance_set_facts(spark, folder):
    """Three columns a family, so all but nine lie outside the three best; an unused column is in no smallest set."""
    return _job("importance_column_sets", spark, folder).agg(
        F.count(F.lit(1)).alias("columnas"), F.count_distinct("familia").alias("familias"), F.count_if(F.col("fuera_de_las_10")).alias("fuera"),
        F.count_if(F.col("sin_uso") & F.col("en_el_99")).alias("contradicciones"),
    )


@query("canary_pruning_facts", "ML7 TG11 AG14", "select 0::bigint as votos_imposibles, 0::bigint as mayoria_mal, 0::bigint as ajenas")
def canary_pruning_facts(spark, folder):
    votes = _job("canary_pruning", spark, folder)
    return votes.agg(
        F.count_if(~F.col("votos").between(1, len(K.SEEDS))).alias("votos_imposibles"),
        F.count_if(F.col("sobrevive") != (F.col("votos") >= len(K.SEEDS) // 2 + 1)).alias("mayoria_mal"),
        F.count_if(~F.col("feature").isin(*Q.WITH_HISTORY)).alias("ajenas"),
    )


_CRITERIA = [M._criterion(d) for d in M.CRITERIA]


@query(
    "pruning_sweep_facts", "ML7",
    f"select cast(unnest([{', '.join(map(str, K.SEEDS[:2]))}]) as int) as semilla, {len(_CRITERIA)}::bigint as criterios, true as suma, true as crece",
)
def pruning_sweep_facts(spark, folder):
    """A laxer criterion keeps no fewer columns; base and derived columns add up to those alive."""
    alive = {d: F.max(F.when(F.col("criterio") == M._criterion(d), F.col("vivas"))) for d in M.CRITERIA[1:]}
    grows = (alive[0.0] <= alive[1.0]) & (alive[1.0] <= alive[2.0]) & (alive[2.0] <= alive[4.0])
    return _job("pruning_sweep", spark, folder).groupBy("semilla").agg(
        F.count(F.lit(1)).alias("criterios"), F.every(F.col("base") + F.col("derivadas") == F.col("vivas")).alias("suma"), grows.alias("crece")
    )


@query(
    "ablation_facts", "ML8 SR6",
    f"select unnest(['base', 'con_historia']) as config, {len(Q.FOLDS) * len(Q.SEEDS)}::bigint as observaciones, true as posible",
)
def ablation_facts(spark, folder):
    """A gain at K is a number of hits times what a hit is worth, less the cost of K; months of fewer rows have none."""
    unit, cost = K.GAIN_HIT + K.COST_MISS, K.COST_MISS * _K
    hits = (F.col("ganancia") + cost) / unit
    possible = (hits == F.floor(hits)) & hits.between(0, _K)
    return _job("feature_set_ablation", spark, folder).groupBy("config").agg(
        F.count(F.lit(1)).alias("observaciones"), F.every(F.coalesce(possible, F.lit(True))).alias("posible")
    )


@query(
    "variant_grid_facts", "ML16 ML8",
    f"""select config, cast(modelo as int) as modelo, cast(envios as bigint) as envios, true as posible
      from (select unnest(['simple', 'pesos']) as config), (select unnest([{", ".join(map(str, Q.SEEDS))}]) as modelo), (select unnest([100, 200]) as envios)""",
)
def variant_grid_facts(spark, folder):
    """Configurations (columns, target, months, seeds) by seed and cut, from one table of configurations."""
    panel = checkpoint(labelled(spark, folder, Q.COLUMNS))
    base = {"columnas": Q.COLUMNS, "mes": 202106, "semillas": Q.SEEDS, "params": {"maxIter": 2}}
    grid = M.variants(panel, {
        "simple": {**base, "target": "baja2", "meses": (202104,)},
        "pesos": {**base, "target": "pesos", "peso_baja1": 0.25, "meses": (202103, 202104)},
    }, (100, 200))
    hits = (F.col("ganancia") + K.COST_MISS * F.col("envios")) / (K.GAIN_HIT + K.COST_MISS)
    possible = (hits == F.floor(hits)) & hits.between(0, F.col("envios"))
    return grid.select("config", "modelo", "envios", F.coalesce(possible, F.lit(True)).alias("posible"))


@query(
    "adversarial_facts", "ML13 TG8",
    f"select {len(Q.COLUMNS)}::bigint as columnas, 100.0::double as suma, true as auc_posible",
)
def adversarial_facts(spark, folder):
    auc, table = M.adversarial(Q._panel(spark, folder), Q.COLUMNS, (202103, 202104), 202109, Q.SEEDS[0])
    possible = auc.agg(F.every(F.col("auc").between(0, 1)).alias("auc_posible"))
    facts = table.agg(F.count(F.lit(1)).alias("columnas"), F.round(F.sum("gain_pct"), 6).alias("suma"))
    return facts.select("*", possible.scalar().alias("auc_posible"))


@query(
    "search_facts", "ML15 ML14",
    "select unnest(['receta', 'mas_hondo', 'mas_lento']) as config, true as posible, true as puestos, true as rho_posible",
)
def search_facts(spark, folder):
    return _job("out_of_time_search", spark, folder).select(
        "config", (F.col("auc_busqueda").between(0, 1) & F.col("auc_futuro").between(0, 1)).alias("posible"),
        (F.col("puesto_busqueda").between(1, 3) & F.col("puesto_futuro").between(1, 3)).alias("puestos"),
        F.coalesce(F.col("rho").between(-1 - 1e-9, 1 + 1e-9), F.lit(True)).alias("rho_posible"),
    )


@query(
    "ageing_facts", "ML17 DC5",
    _PANEL + f""", n as (select count(*) as n from {_month(202105)}), m as (select count(*) as n from {_month(202106)})
    select cast(d.distancia as int) as distancia, count(*) as cortes, true as posible, true as crece from
      (select 2 as distancia, n from n union all select 3, n from m) d, (select unnest([100, 200, 300, 400, 500]) as K) k where k.K <= d.n group by 1""",
)
def ageing_facts(spark, folder):
    """Captures are shares and never fall as the cut grows."""
    curve = _job("prediction_distance_ageing", spark, folder)
    earlier = curve.select("distancia", (F.col("K") + 100).alias("K"), F.col("captura").alias("_before"))
    return curve.join(earlier, ["distancia", "K"], "left").groupBy("distancia").agg(
        F.count(F.lit(1)).alias("cortes"), F.every(F.col("captura").between(0, 1)).alias("posible"),
        F.every(F.coalesce(F.col("_before") <= F.col("captura"), F.lit(True))).alias("crece"),
    )


@query(
    "month_quality_facts", "ML18",
    """select meses, cast(distancia as int) as distancia, true as posible
      from (values ('marzo', 3), ('abril', 2), ('marzo_abril', 2)) v(meses, distancia)""",
)
def month_quality_facts(spark, folder):
    return _job("training_month_quality", spark, folder).select("meses", "distancia", F.coalesce(F.col("captura").between(0, 1), F.lit(True)).alias("posible"))


@query(
    "prevalence_facts", "DC9 ML2",
    _PANEL + f""" select {P}, sum(case when {L} = 'BAJA+2' then 1 else 0 end)::bigint as real, true as posible
      from labelled where {P} in (202106, 202108) group by 1""",
)
def prevalence_facts(spark, folder):
    return _job("model_prevalence", spark, folder).select(P, "real", ((F.col("suma_p_media") >= 0) & (F.col("suma_p_sd") >= 0)).alias("posible"))


# --- the whole way from a raw file to a guarded export ----------------------------------------

_SENT = 0.1


@query(
    "file_to_export", "IO1 PN1 PN3 TG1 ML1 ML2 EN1 WN24 DQ9 IO6",
    _PANEL + f""" select cast(floor({_SENT} * count(*)) as bigint) as enviados, cast(floor({_SENT} * count(*)) as bigint) as clientes, 0::bigint as ajenos,
      count(*) as poblacion from {_month(202106)}""",
)
def file_to_export(spark, folder):
    """Raw CSV, label, history, a model per seed, rank ensemble, top share, guard, export; then the exported file is read back.

    The assembled panel is materialised once. The guard refuses entities that the month does not have.
    """
    root = files.shared_folder(spark, "file_to_export")
    files.write_csv(bank_panel(spark, folder, Q.COLUMNS), f"{root}/crudo", compression="gzip")
    panel = Q._with_history(churn_label(files.read_csv(spark, f"{root}/crudo")))
    data = checkpoint(M.assembled(panel, Q.WITH_HISTORY))
    month = checkpoint(data.filter(F.col(P) == 202106).select(E))
    scores = M.fit_and_score(Q._train(data), data.filter(F.col(P) == 202106), Q.SEEDS)
    n = month.count()
    chosen = R.top_k(R.rank_ensemble(scores), int(_SENT * n))
    files.export_selection(chosen, f"{root}/envio", valid=month, lowest=0, highest=n)
    sent = files.read_selection(spark, f"{root}/envio").join(month.withColumn("_en", F.lit(1)), E, "left")
    return sent.agg(
        F.count(F.lit(1)).alias("enviados"), F.count_distinct(E).alias("clientes"), F.count_if(F.col("_en").isNull()).alias("ajenos"),
        F.lit(n).cast("long").alias("poblacion"),
    )


# --- a forest of fixed trees ------------------------------------------------------------------

_TREES, _FIXED_MODELS, _DEPTH = 5, 3, 3
_FIXED_COLUMNS = ["ctrx_quarter", "mcuentas_saldo", "mpayroll", "Visa_status"]
_SPLITS = 2**_DEPTH - 1
#: Columns of a node, from its numbers and the range of its column; read alike by Spark and the check SQL.
_NODE_COLUMNS = [
    "modelo", "arbol", "nodo", "case when arbol = 0 then cast(1 as double) else cast(arbol as double) / 8 end as peso",
    "(modelo + arbol + nodo) % 4 as columna", f"cast(case when nodo < {_SPLITS} then 2 * nodo + 1 else -1 end as int) as izquierda",
    f"cast(case when nodo < {_SPLITS} then 2 * nodo + 2 else -1 end as int) as derecha",
    "cast((nodo * 37 + arbol * 11 + modelo * 5) % 101 - 50 as double) / 64 as valor", "(nodo * 7 + arbol * 3 + modelo) % 10 as tramo",
]
_NODE = ", ".join(_NODE_COLUMNS)


@query(
    "fixed_forest_scores", "ML1 ML2 ML16",
    bank_sql(_FIXED_COLUMNS).replace("with lines", "with recursive lines", 1) + f""",
    alcance as ({" union all ".join(f"select {i} as columna, min(cast({c} as double)) as bajo, max(cast({c} as double)) as alto from panel" for i, c in enumerate(_FIXED_COLUMNS))}),
    numeros as (select m.i as modelo, a.i as arbol, n.i as nodo from range({_FIXED_MODELS}) m(i), range({_TREES}) a(i), range({2 * _SPLITS + 1}) n(i)),
    hojas as (select x.*, bajo + (alto - bajo) * tramo / 40 as corte from (select {_NODE} from numeros) x join alcance using (columna)),
    filas as (select {E}, {P}, [{", ".join(f"coalesce(cast({c} as double), (select bajo - 1 from alcance where columna = {i}))" for i, c in enumerate(_FIXED_COLUMNS))}] as x from panel),
    paso as (
      select {E}, {P}, modelo, arbol, nodo, x from filas, numeros where nodo = 0
      union all select p.{E}, p.{P}, p.modelo, p.arbol, case when p.x[h.columna + 1] <= h.corte then h.izquierda else h.derecha end, p.x
      from paso p join hojas h on h.modelo = p.modelo and h.arbol = p.arbol and h.nodo = p.nodo where h.izquierda >= 0)
    select {E}, {P}, cast(modelo as int) as modelo, round(1 / (1 + exp(-2 * sum(peso * valor))), 9) as score
    from paso join hojas using (modelo, arbol, nodo) where izquierda < 0 group by 1, 2, 3""",
)
def fixed_forest_scores(spark, folder):
    """Three models of five trees each, whose cuts lie in the ranges of the panel's columns, score every row of it in one scan."""
    panel = checkpoint(bank_panel(spark, folder, _FIXED_COLUMNS))
    spans = [F.struct(F.lit(i).alias("columna"), F.min(F.col(c).cast("double")).alias("bajo"), F.max(F.col(c).cast("double")).alias("alto"))
             for i, c in enumerate(_FIXED_COLUMNS)]
    ranges = panel.agg(F.array(*spans).alias("a")).select(F.inline("a"))
    size = 2 * _SPLITS + 1
    numbers = spark.range(_FIXED_MODELS * _TREES * size).selectExpr(
        f"id div {_TREES * size} as modelo", f"cast(id div {size} % {_TREES} as int) as arbol", f"cast(id % {size} as int) as nodo")
    nodes = numbers.selectExpr(*_NODE_COLUMNS).join(ranges, "columna").withColumns({
        "corte": F.col("bajo") + (F.col("alto") - F.col("bajo")) * F.col("tramo") / 40, "hondo": F.lit(_DEPTH),
        "columna": F.col("columna").cast("int"),
    })
    scored = forest_scores(checkpoint(nodes), M.assembled(panel, _FIXED_COLUMNS), (E, P))
    return scored.withColumn("score", F.round("score", 9))
