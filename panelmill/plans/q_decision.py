"""Queries that turn scores into rankings, curves, cuts, ensembles and resampled comparisons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators import curves as C
from panelmill.operators import ranking as R
from panelmill.operators import resampling as S
from panelmill.plans.base import E, P
from panelmill.plans.registry import query
from panelmill.plans.scores import (
    MODELS,
    RANK_FRACTION_SQL,
    SCORED_PERIOD,
    ranked_sql,
    scores,
    scores_sql,
    uniform_sql,
)
from panelmill.session import checkpoint

#: Curves are shown at so many equal shares of their month; optima are searched at every place.
PARTS = 40
KS = (100, 200, 300, 400)
SCENARIOS = (60, 120, 180, 240)
_RANKED = scores_sql() + ranked_sql()
_RANKED_ALL = scores_sql(True) + ranked_sql(f"modelo, {P}")


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _ranked(spark, folder):
    return R.ranking(scores(spark, folder), ["modelo"])


# --- rankings ---------------------------------------------------------------------------------

@query(
    "cumulative_gain", "WN26 DC1 DC2",
    _RANKED + f" select {E}, modelo, score, puesto, n, ganancia, aciertos, positivos from ranked",
)
def cumulative_gain(spark, folder):
    return _ranked(spark, folder).select(E, "modelo", "score", "puesto", "n", "ganancia", "aciertos", "positivos")


@query("gain_at_cut", "DC2", _RANKED + " select modelo, 300::bigint as envios, max(case when puesto = 300 then ganancia end) as ganancia from ranked group by 1")
def gain_at_cut(spark, folder):
    return R.gain_at(_ranked(spark, folder), 300, ["modelo"])


@query(
    "top_selection", "WN24 ST3 DQ10",
    scores_sql() + f" select {E}, score from scores where modelo = 1 order by score desc, {E} limit 300",
)
def top_selection(spark, folder):
    table = scores(spark, folder).filter("modelo = 1")
    R.require_binary(table, "positivo")
    return R.top_k(table, 300).select(E, "score")


@query("top_selection_per_model", "WN24", _RANKED + f" select {E}, modelo, score from ranked where puesto <= 300")
def top_selection_per_model(spark, folder):
    return R.top_k(scores(spark, folder), 300, ["modelo"]).select(E, "modelo", "score")


@query(
    "many_cuts", "EN5 WN24",
    scores_sql() + RANK_FRACTION_SQL + f""",
    ens as (select {E}, avg(rango) as score, max(positivo) as positivo from fractions group by 1)
    {ranked_sql('', 'ens')}
    select k as corte, count(*) as elegidos, sum(positivo)::bigint as aciertos, min({E}) as primero
    from ranked cross join (select unnest([{", ".join(map(str, KS))}]) as k) where puesto <= k group by 1""",
)
def many_cuts(spark, folder):
    """One ranking of the ensemble, cut at several K without scoring again."""
    ensemble = R.rank_ensemble(scores(spark, folder), keep=["positivo"])
    return R.cuts(R.ranking(ensemble), KS).groupBy("corte").agg(
        F.count(F.lit(1)).alias("elegidos"), F.sum("positivo").alias("aciertos"), F.min(E).alias("primero")
    )


@query(
    "skip_flagged_selection", "ST8",
    scores_sql() + f""" select {E}, score from scores where modelo = 1 and cpayroll_trx = 0
    order by score desc, {E} limit 200""",
)
def skip_flagged_selection(spark, folder):
    """Skip the flagged rows and take the next best instead."""
    table = scores(spark, folder).filter("modelo = 1")
    return R.top_k(table.filter(F.col("cpayroll_trx") == 0), 200).select(E, "score")


@query(
    "canonical_order", "ST1 ST2",
    scores_sql(True) + f" select {E}, {P}, score from scores where modelo = 1",
)
def canonical_order(spark, folder):
    return scores(spark, folder, every_period=True).filter("modelo = 1").select(E, P, "score").orderBy(E, P)


# --- curves and cuts --------------------------------------------------------------------------

_SHOWN = f"floor(puesto * {PARTS} / n) > floor((puesto - 1) * {PARTS} / n)"


def _shown(spark, folder):
    return C.display(_ranked(spark, folder), PARTS)


@query("cut_curve", "DC3", _RANKED + f" select modelo, puesto as envios, ganancia from ranked where {_SHOWN}")
def cut_curve(spark, folder):
    return _shown(spark, folder).select("modelo", F.col("puesto").alias("envios"), "ganancia")


@query(
    "best_cut_per_model", "ST4",
    _RANKED + """ select modelo, puesto as envios, ganancia, n from (select *,
      row_number() over (partition by modelo order by ganancia desc, puesto) as o from ranked) where o = 1""",
)
def best_cut_per_model(spark, folder):
    return C.best_cuts(scores(spark, folder), ["modelo"])


@query(
    "gain_plateau", "DC4 AG13",
    _RANKED + """, m as (select puesto as K, avg(ganancia) as media from ranked group by 1),
    a as (select min(K) as desde, max(K) as hasta from m where media >= (select max(media) from m) * 0.9::double), t as (select max(n) as n from ranked)
    select (select K from m order by media desc, K limit 1) as mejor, desde,
      cast(greatest(least((desde + hasta) // 2, floor(n * 0.95::double)), floor(n * 0.05::double)) as bigint) as centro, hasta from a cross join t""",
)
def gain_plateau(spark, folder):
    means = C.mean_curve(_ranked(spark, folder), F.col("ganancia"), ["modelo"], "ganancia")
    return C.plateau(means, tolerance=0.9, low=0.05, high=0.95)


_CAPTURE = """caps as (select modelo, puesto as K, n, aciertos / positivos as captura from ranked),
  captura as (select K, max(n) as n, avg(captura) as captura from caps group by 1)"""
_SHOWN_K = _SHOWN.replace("puesto", "K")


@query("capture_curve", "DC5", _RANKED + f" select modelo, puesto as K, aciertos / positivos as captura from ranked where {_SHOWN}")
def capture_curve(spark, folder):
    share = F.try_divide(F.col("aciertos"), F.col("positivos"))
    return _shown(spark, folder).select("modelo", F.col("puesto").alias("K"), share.alias("captura"))


def _losses(spark, folder):
    captures = C.mean_curve(_ranked(spark, folder), F.try_divide(F.col("aciertos"), F.col("positivos")), ["modelo"], "captura")
    return C.scenario_losses(captures, SCENARIOS)


_EXPECTED = f""", {_CAPTURE},
  esperada as (select prevalencia, K, n, captura * prevalencia * {K.GAIN_HIT} - (K - captura * prevalencia) * {K.COST_MISS} as ganancia
    from captura cross join (select cast(unnest([{", ".join(map(str, SCENARIOS))}]) as double) as prevalencia)),
  mejores as (select prevalencia, max(ganancia) as mejor from esperada group by 1),
  perdida as (select prevalencia, K, n, ganancia, 100.0::double * (mejor - ganancia) / mejor as regret_pct from esperada join mejores using (prevalencia)),
  resumen as (select K, max(regret_pct) as peor, round(avg(regret_pct), 9) as medio from perdida group by 1)"""


@query("expected_gain_scenarios", "DC6", _RANKED + _EXPECTED + f" select prevalencia, K, round(ganancia, 2) as ganancia from esperada where {_SHOWN_K}")
def expected_gain_scenarios(spark, folder):
    shown = _losses(spark, folder).filter(C.on_display(PARTS, "K"))
    each = F.explode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in SCENARIOS]).alias("p"), "ganancias")).alias("e")
    return _round(shown.select("K", each).select(F.col("e.p").alias("prevalencia"), "K", F.col("e.ganancias").alias("ganancia")), 2, "ganancia")


@query(
    "scenario_regret", "DC7 AG12",
    _RANKED + _EXPECTED + " select K, " + ", ".join(
        f'round(max(case when prevalencia = {s} then regret_pct end), 6) as "p{s}"' for s in SCENARIOS)
    + f", round(max(regret_pct), 6) as peor, round(avg(regret_pct), 6) as medio from perdida where {_SHOWN_K} group by 1",
)
def scenario_regret(spark, folder):
    """Shown at shares of the month; the loss is against the best of all places."""
    shown = _losses(spark, folder).filter(C.on_display(PARTS, "K"))
    each = [F.round(F.get("perdidas", F.lit(i)), 6).alias(f"p{s}") for i, s in enumerate(SCENARIOS)]
    return _round(shown.select("K", *each, "peor", "medio"), 6, "peor", "medio")


@query(
    "minimax_cut", "DC8 DC7",
    _RANKED + _EXPECTED + """ select (select K from resumen order by peor, K limit 1) as corte_minimax,
      (select K from resumen order by medio, K limit 1) as corte_esperado, round((select min(peor) from resumen), 6) as peor_en_minimax""",
)
def minimax_cut(spark, folder):
    """Over every place; mean losses that agree to nine digits tie, as the order of their sum is free."""
    losses = _round(_losses(spark, folder), 9, "medio")
    return _round(C.minimax(losses, "K", losses_positive=True), 6, "peor_en_minimax")


_CURVE_REGRET = f""",
  curvas as (select {P}, puesto, n, ganancia, max(ganancia) over (partition by {P}) as mejor from ranked where modelo = 1),
  r as (select {P}, puesto, n, ganancia / mejor - 1 as regret from curvas),
  resumen as (select puesto as envios, min(regret) as peor, round(avg(regret), 9) as medio from r group by 1
    having count(*) = (select count(distinct {P}) from r))"""


def _period_losses(spark, folder):
    return C.curve_losses(R.ranking(scores(spark, folder, True).filter("modelo = 1"), [P]), [P])


@query("curve_regret", "DC7 DC8", _RANKED_ALL + _CURVE_REGRET + f" select {P}, puesto as envios, round(regret, 9) as regret from r where {_SHOWN}")
def curve_regret(spark, folder):
    """Scenarios are periods; the loss is relative to the best point of the whole curve."""
    shown = C.display(_period_losses(spark, folder), PARTS)
    return _round(shown.select(P, F.col("puesto").alias("envios"), "regret"), 9, "regret")


@query(
    "curve_minimax", "DC8",
    _RANKED_ALL + _CURVE_REGRET + """ select (select envios from resumen order by peor desc, envios limit 1) as corte_minimax,
      (select envios from resumen order by medio desc, envios limit 1) as corte_esperado,
      round((select max(peor) from resumen), 9) as peor_en_minimax""",
)
def curve_minimax(spark, folder):
    """Over every place that all periods have."""
    losses = checkpoint(_period_losses(spark, folder).select(P, "puesto", "regret"))
    periods = losses.select(F.countDistinct(P)).scalar()
    summary = losses.groupBy(F.col("puesto").alias("envios")).agg(
        F.min("regret").alias("peor"), F.round(F.avg("regret"), 9).alias("medio"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") == periods)
    return _round(C.minimax(summary, "envios", losses_positive=False), 9, "peor_en_minimax")


@query(
    "marginal_hit_rate", "DC10",
    _RANKED + f""" select modelo, cast(ceil(puesto / 100) as bigint) as banda, count(*) as n,
      sum(positivo)::bigint as aciertos, sum(positivo) / count(*) as tasa, sum(positivo) / count(*) >= {K.BREAK_EVEN!r}::double as rinde
    from ranked group by 1, 2""",
)
def marginal_hit_rate(spark, folder):
    return R.band_rates(_ranked(spark, folder), 100, ["modelo"])


@query(
    "quadratic_optimum", "DC11",
    _RANKED + f""",
    pts as (select puesto as envios, avg(ganancia) as media, stddev(ganancia) / sqrt(count(*)) as error
      from ranked where {_SHOWN} group by 1),
    c as (select avg(envios) as c, greatest(max(envios) - min(envios), 1) as s from pts),
    u as (select (envios - c) / s as u, media as y, pow(1.0::double / error, 2) as w from pts cross join c where error > 0),
    q as (select sum(w) as s0, sum(w*u) as s1, sum(w*u*u) as s2, sum(w*u*u*u) as s3, sum(w*u*u*u*u) as s4,
      sum(w*y) as t0, sum(w*u*y) as t1, sum(w*u*u*y) as t2 from u),
    k as (select (s1*s3 - s2*s2)*t0 + (s1*s2 - s0*s3)*t1 + (s0*s2 - s1*s1)*t2 as a,
      (s2*s3 - s1*s4)*t0 + (s0*s4 - s2*s2)*t1 + (s1*s2 - s0*s3)*t2 as b from q)
    select round(c + s * (-b / (2 * a)), 3) as vertice, a < 0 as es_maximo from k cross join c""",
)
def quadratic_optimum(spark, folder):
    curves = _shown(spark, folder).withColumnRenamed("puesto", "envios")
    points = R.seed_statistics(curves, ["envios"], "ganancia")
    return _round(R.quadratic_vertex(points, "envios", "media", "error"), 3, "vertice")


_AROUND = (-30, -20, -10, 0, 10, 20, 30)


@query(
    "cost_around_optimum", "DC12",
    _RANKED + f""", b as (select modelo, arg_max(puesto, ganancia * 100000 - puesto) as optimo, max(ganancia) as mejor from ranked group by 1)
    select r.modelo, optimo, cast(o.d as int) as milesimas, puesto as envios, ganancia - mejor as diferencia from ranked r join b using (modelo)
    cross join (select unnest({list(_AROUND)}) as d) o where puesto = optimo + floor(o.d * n / 1000)""",
)
def cost_around_optimum(spark, folder):
    """What cutting some thousandths of the month before or after the best of all places costs."""
    ranked = _ranked(spark, folder)
    best = C.best_cuts(scores(spark, folder), ["modelo"]).select("modelo", F.col("envios").alias("optimo"), F.col("ganancia").alias("mejor"), "n")
    offsets = F.explode(F.array(*[F.lit(d) for d in _AROUND]))
    marks = best.withColumn("milesimas", offsets).withColumn("puesto", F.col("optimo") + F.floor(F.col("milesimas") * F.col("n") / 1000))
    near = ranked.select("modelo", "puesto", "ganancia").join(F.broadcast(marks.drop("n")), ["modelo", "puesto"])
    return near.select("modelo", "optimo", "milesimas", F.col("puesto").alias("envios"), (F.col("ganancia") - F.col("mejor")).alias("diferencia"))


@query(
    "marginal_push", "DC13",
    _RANKED + f""",
    moved as (select *, puesto as antes_, (cproductos = 1 and puesto between 300 and 700) as pasa from ranked),
    again as (select modelo, row_number() over w as p2, cast(sum(case when positivo = 1 then {K.GAIN_HIT} else -{K.COST_MISS} end) over w as bigint) as g2
      from moved window w as (partition by modelo order by pasa desc, antes_ rows between unbounded preceding and current row))
    select r.modelo, r.ganancia as antes, a.g2 as despues, a.g2 - r.ganancia as cambio
    from ranked r join again a on a.modelo = r.modelo and a.p2 = 300 where r.puesto = 300""",
)
def marginal_push(spark, folder):
    return R.push_test(_ranked(spark, folder), F.col("cproductos") == 1, 300, 700, 300, ["modelo"])


@query(
    "selection_agreement", "DC14 AG14",
    _RANKED + f""", v as (select {E}, sum(case when puesto <= 300 then 1 else 0 end) as v from ranked where positivo = 1 group by 1)
    select case when v = 0 then 'ninguno' when v = 5 then 'todos' else 'algunos' end as lo_mandan, count(*) as positivos from v group by 1""",
)
def selection_agreement(spark, folder):
    return R.selection_agreement(_ranked(spark, folder), 300, len(MODELS))


@query(
    "votes_across_lists", "AG14",
    _RANKED + f""", v as (select {E}, count(*) as listas from ranked where puesto <= 300 group by 1)
    select listas, count(*) as clientes from v group by 1""",
)
def votes_across_lists(spark, folder):
    return R.votes(R.top_k(scores(spark, folder), 300, ["modelo"]))


@query(
    "seed_statistics", "AG13 SR7",
    _RANKED + f""", o as (select puesto as envios, modelo, ganancia from ranked where {_SHOWN})
    select envios, avg(ganancia) as media, round(stddev_pop(ganancia), 4) as sd_poblacion, round(stddev(ganancia), 4) as sd_muestra,
      round(stddev(ganancia) / sqrt(count(*)), 4) as error, count(*) as n from o group by 1""",
)
def seed_statistics(spark, folder):
    curves = _shown(spark, folder).withColumnRenamed("puesto", "envios")
    stats = R.seed_statistics(curves, ["envios"], "ganancia")
    return _round(stats, 4, "sd_poblacion", "sd_muestra", "error")


@query(
    "first_seeds_against_all", "SR7",
    _RANKED + f""", o as (select modelo, puesto as envios, ganancia from ranked where {_SHOWN})
    select envios, avg(case when modelo <= 2 then ganancia end) as media_primeras, avg(ganancia) as media_todas,
      round((avg(case when modelo <= 2 then ganancia end) - avg(ganancia)) / nullif(stddev(ganancia) / sqrt(count(*)), 0), 6) as z
    from o group by 1""",
)
def first_seeds_against_all(spark, folder):
    """Do the first seeds look better than all of them? z is in standard errors of the whole."""
    curves = _shown(spark, folder).withColumnRenamed("puesto", "envios")
    first, all_ = F.avg(F.when(F.col("modelo") <= 2, F.col("ganancia"))), F.avg("ganancia")
    error = F.stddev("ganancia") / F.sqrt(F.count(F.lit(1)).cast("double"))
    return curves.groupBy("envios").agg(
        first.alias("media_primeras"), all_.alias("media_todas"), F.round(F.try_divide(first - all_, error), 6).alias("z")
    )


@query(
    "prevalence_estimate", "DC9",
    scores_sql(True) + f""", s as (select {P}, modelo, sum(cast(round(score * 10000) as bigint)) / 10000.0::double as suma_p, sum(positivo) as real from scores group by 1, 2)
    select {P}, round(avg(suma_p), 6) as suma_p_media, round(stddev_pop(suma_p), 6) as suma_p_sd, max(real)::bigint as real,
      round(max(real) / nullif(avg(suma_p), 0), 6) as calibracion from s group by 1""",
)
def prevalence_estimate(spark, folder):
    """Expected positives of a period: the sum of probabilities, per model; against the known count."""
    total = (F.sum(F.round(F.col("score") * 10000).cast("long")) / F.lit(10000.0)).alias("suma_p")
    sums = scores(spark, folder, True).groupBy(P, "modelo").agg(total, F.sum("positivo").alias("real"))
    mean = F.avg("suma_p")
    return sums.groupBy(P).agg(
        F.round(mean, 6).alias("suma_p_media"), F.round(F.stddev_pop("suma_p"), 6).alias("suma_p_sd"),
        F.max("real").alias("real"), F.round(F.try_divide(F.max("real").cast("double"), mean), 6).alias("calibracion"),
    )


# --- ensembles --------------------------------------------------------------------------------

@query(
    "fractional_ranks", "WN25",
    scores_sql() + RANK_FRACTION_SQL + f" select {E}, modelo, score, rango from fractions",
)
def fractional_ranks(spark, folder):
    return R.fractional_ranks(scores(spark, folder)).select(E, "modelo", "score", "rango")


@query(
    "rank_ensemble", "EN1",
    scores_sql() + RANK_FRACTION_SQL + f" select {E}, round(avg(rango), 9) as score from fractions group by 1",
)
def rank_ensemble(spark, folder):
    return _round(R.rank_ensemble(scores(spark, folder)), 9, "score")


@query(
    "weighted_rank_mix", "EN2 JN9 SR8",
    scores_sql() + RANK_FRACTION_SQL + f"""
    select a.{E}, a.modelo, 0.7::double * a.rango + 0.3::double * b.rango as score from fractions a
    join fractions b on a.{E} = b.{E} and b.modelo = a.modelo + 2 where a.modelo in (1, 2)""",
)
def weighted_rank_mix(spark, folder):
    table = scores(spark, folder).select(E, "modelo", "score")
    first = table.filter("modelo in (1, 2)")
    second = table.filter("modelo in (3, 4)").withColumn("modelo", F.col("modelo") - 2)
    R.require_aligned(first, second)
    return R.weighted_mix(first, second, 0.3).select(E, "modelo", "score")


@query(
    "heterogeneous_ensembles", "EN3",
    scores_sql() + RANK_FRACTION_SQL + f""",
    t as (select *, cast(modelo % 2 as int) as prueba, cast(modelo // 2 as int) as semilla from fractions)
    select {E}, 'prueba ' || prueba as conjunto, round(avg(rango), 9) as score from t group by 1, 2
    union all select {E}, 'semilla ' || semilla, round(avg(rango), 9) from t group by 1, 2
    union all select {E}, 'todo', round(avg(rango), 9) from t group by 1, 2""",
)
def heterogeneous_ensembles(spark, folder):
    """Rank every (trial, seed) once; average by trial, by seed and over everything."""
    ranks = R.fractional_ranks(scores(spark, folder))
    sets = F.explode(F.array(
        F.concat(F.lit("prueba "), (F.col("modelo") % 2).cast("string")),
        F.concat(F.lit("semilla "), F.floor(F.col("modelo") / 2).cast("string")),
        F.lit("todo"),
    ))
    return ranks.withColumn("conjunto", sets).groupBy(E, "conjunto").agg(F.round(F.avg("rango"), 9).alias("score"))


@query(
    "score_alignment", "JN9 JN10",
    scores_sql(True) + f""",
    a as (select {E}, modelo from scores where {P} = 202105), b as (select {E}, modelo from scores where {P} = 202106)
    select modelo, sum(case when a1 and b1 then 1 else 0 end)::bigint as en_ambas, sum(case when not b1 then 1 else 0 end)::bigint as solo_izquierda,
      sum(case when not a1 then 1 else 0 end)::bigint as solo_derecha
    from (select modelo, {E}, a.{E} is not null as a1, b.{E} is not null as b1 from a full join b using ({E}, modelo)) group by 1""",
)
def score_alignment(spark, folder):
    table = scores(spark, folder, True)
    return R.alignment(table.filter(f"{P} = 202105"), table.filter(f"{P} = 202106"), ["modelo"])


@query(
    "list_overlap", "ST6",
    _RANKED + f""" select r.modelo, count(*) as elegidos, count(b.{E}) as comunes, count(*) - count(b.{E}) as cambian, count(b.{E}) / count(*) as solape
    from ranked r left join (select {E} from ranked where modelo = 1 and puesto <= 300) b on b.{E} = r.{E}
    where r.puesto <= 300 group by 1""",
)
def list_overlap(spark, folder):
    chosen = R.top_k(scores(spark, folder), 300, ["modelo"])
    return R.overlap(chosen, chosen.filter("modelo = 1"), ["modelo"])


@query(
    "list_difference", "ST7 ST5",
    _RANKED + f""", a as (select {E} from ranked where modelo = 1 and puesto <= 300), b as (select {E} from ranked where modelo = 2 and puesto <= 300)
    select {E}, 'izquierda' as lado from a where {E} not in (select {E} from b)
    union all select {E}, 'derecha' from b where {E} not in (select {E} from a)""",
)
def list_difference(spark, folder):
    chosen = R.top_k(scores(spark, folder), 300, ["modelo"])
    return R.symmetric_difference(chosen.filter("modelo = 1"), chosen.filter("modelo = 2"))


_GUARD = {"sin_movimientos": "ctrx_quarter = 0", "saldo_en_rojo": "mcuentas_saldo < 0", "sin_sueldo": "cpayroll_trx = 0"}


@query(
    "selection_guard", "DQ9 JN11",
    _RANKED + f""", t as (select r.*, f.marcador, f.on_ from ranked r, lateral (values {", ".join(
        f"('{n}', coalesce({c}, false))" for n, c in _GUARD.items())}) f(marcador, on_) where modelo = 1),
    g as (select marcador, sum(case when puesto <= 300 then 1 else 0 end)::bigint as cubiertos,
      avg(case when puesto <= 300 then on_::int end) as p_elegidos, avg(case when puesto > 300 then on_::int end) as p_resto from t group by 1),
    p as (select least(300, count(*)) as pedidos from scores where modelo = 1)
    select marcador, cubiertos, p_elegidos, p_resto, round(p_elegidos / nullif(p_resto, 0), 9) as lift, cubiertos = pedidos as cobertura_total,
      coalesce(cubiertos = pedidos and min(case when p_elegidos / nullif(p_resto, 0) is null then 0 else 1 end) over () = 1
        and max(p_elegidos / nullif(p_resto, 0)) over () >= 2, false) as valida from g cross join p""",
)
def selection_guard(spark, folder):
    table = scores(spark, folder).filter("modelo = 1")
    return _round(R.selection_guard(R.top_k(table, 300), table, _GUARD), 9, "lift")


# --- resampling -------------------------------------------------------------------------------

REPS, PAIRED_REPS, BOOTSTRAPS = 500, 2_000, 1_000
_DRAWS = f""", sel as (select * from ranked where puesto <= 300),
  sorteo as (select s.modelo, r.rep, case when {uniform_sql(E, 'rep')} < 0.25 then 1 else 0 end as pub,
    case when positivo = 1 then {K.GAIN_HIT} else -{K.COST_MISS} end as g
    from sel s cross join (select cast(unnest(range(1, {REPS} + 1)) as int) as rep) r),
  draws as (select modelo, rep, sum(case when pub = 1 then g else 0 end)::bigint as publico,
    sum(case when pub = 1 then 0 else g end)::bigint as privado from sorteo group by 1, 2)"""


_PAIRED_DRAWS = _DRAWS.replace(f"range(1, {REPS} + 1)", f"range(1, {PAIRED_REPS} + 1)")


def _draws(spark, folder, table=None):
    table = scores(spark, folder) if table is None else table
    return S.public_draws(R.top_k(table, 300, ["modelo"]), REPS, group=["modelo"])


@query("public_private_draws", "SR1", _RANKED + _DRAWS + " select * from draws")
def public_private_draws(spark, folder):
    return _draws(spark, folder)


@query(
    "exact_size_draws", "SR1",
    _RANKED + f""", u as (select r.rep, positivo, puesto, row_number() over (partition by r.rep order by {uniform_sql(E, 'r.rep')}, {E}) as rn,
      count(*) over (partition by r.rep) as n from ranked cross join (select cast(unnest(range(1, {REPS} + 1)) as int) as rep) r where modelo = 1)
    select rep, sum(case when rn <= round_even(n * 0.25::double, 0) and puesto <= 300 then case when positivo = 1 then {K.GAIN_HIT} else -{K.COST_MISS} end else 0 end)::bigint as publico,
      sum(case when rn <= round_even(n * 0.25::double, 0) then 1 else 0 end)::bigint as sorteados from u group by 1""",
)
def exact_size_draws(spark, folder):
    ranked = R.ranking(scores(spark, folder).filter("modelo = 1"))
    return S.exact_public_draws(ranked.select(E, "positivo", "puesto"), REPS, 300)


@query(
    "paired_draw_differences", "SR2",
    _RANKED + _PAIRED_DRAWS + f""", real as (select modelo, sum(case when positivo = 1 then {K.GAIN_HIT} else -{K.COST_MISS} end) as total from sel group by 1),
    d as (select p.a, p.b, x.publico - y.publico as d, ra.total - rb.total as real from (values ('1', '2'), ('1', '3')) p(a, b)
      join draws x on x.modelo::varchar = p.a join draws y on y.modelo::varchar = p.b and y.rep = x.rep
      join real ra on ra.modelo::varchar = p.a join real rb on rb.modelo::varchar = p.b)
    select a, b, max(real)::bigint as dif_real, avg(d) as dif_publica_media, round(stddev_pop(d), 4) as sd_dif_publica,
      round(stddev_pop(d) / 0.25, 4) as sd_estimador, avg(case when sign(d) = sign(real) then 1 else 0 end) as acierta_el_orden
    from d group by 1, 2""",
)
def paired_draw_differences(spark, folder):
    table = scores(spark, folder)
    chosen = R.top_k(table, 300, ["modelo"])
    draws = S.public_draws(chosen, PAIRED_REPS, group=["modelo"]).withColumn("modelo", F.col("modelo").cast("string"))
    truth = chosen.groupBy(F.col("modelo").cast("string").alias("modelo")).agg(
        F.sum(R.contribution(F.col("positivo") == 1)).alias("total")
    )
    pairs = S.paired_draws(draws, [("1", "2"), ("1", "3")], truth)
    return _round(pairs, 4, "sd_dif_publica", "sd_estimador")


@query(
    "argmax_bias", "SR3",
    _RANKED + f""", s as (select r.rep, puesto as K,
      case when positivo = 1 then {K.GAIN_HIT} else -{K.COST_MISS} end as g, {uniform_sql(E, 'rep')} < 0.25 as pub
      from ranked cross join (select cast(unnest(range(1, {REPS} + 1)) as int) as rep) r where modelo = 1),
    c as (select rep, K, sum(case when pub then g else 0 end) over w as pub, sum(g) over w as todo from s window w as (partition by rep order by K)),
    o as (select *, row_number() over (partition by rep order by pub desc, K) as o1, row_number() over (partition by rep order by todo desc, K) as o2 from c)
    select rep, max(case when o1 = 1 then K end) as k_publico, max(case when o1 = 1 then todo - pub end)::bigint as privado_en_argmax,
      max(case when o2 = 1 then K end) as k_real from o group by 1""",
)
def argmax_bias(spark, folder):
    return C.draw_optima(R.ranking(scores(spark, folder).filter("modelo = 1")), REPS)


_POISSON = "(" + " + ".join(
    f"case when u >= {c!r}::double then 1 else 0 end" for c in [
        sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]) + ")"


@query(
    "bootstrap_gain_difference", "SR4",
    _RANKED + f""", s as (select {E}, case when positivo = 1 then {K.GAIN_HIT} else -{K.COST_MISS} end as g, modelo from ranked where puesto <= 300 and modelo in (1, 2)),
    d as (select {E}, sum(case when modelo = 1 then g else -g end) as g from s group by 1 having count(*) = 1),
    x as (select rep, g, {uniform_sql(E, 'rep', "'b'")} as u from d cross join (select cast(unnest(range(1, {BOOTSTRAPS} + 1)) as int) as rep)),
    b as (select rep, sum(g * {_POISSON})::double as diferencia from x group by 1)
    select round(avg(diferencia), 4) as media, round(stddev_pop(diferencia), 4) as sd, round(quantile_cont(diferencia, 0.025), 4) as desde,
      round(quantile_cont(diferencia, 0.975), 4) as hasta, count(*) as repeticiones from b""",
)
def bootstrap_gain_difference(spark, folder):
    chosen = R.top_k(scores(spark, folder), 300, ["modelo"])
    draws = S.bootstrap_difference(chosen.filter("modelo = 1"), chosen.filter("modelo = 2"), BOOTSTRAPS)
    return S.interval(draws)


@query(
    "rank_correlation", "SR5 JN10 SR8",
    scores_sql() + RANK_FRACTION_SQL + f""" select round(corr(a.rango, b.rango), 8) as rho, count(*) as n, b.modelo as contra
    from fractions a join fractions b on a.{E} = b.{E} where a.modelo = 1 and b.modelo > 1 group by 3""",
)
def rank_correlation(spark, folder):
    table = scores(spark, folder)
    base = table.filter("modelo = 1").select(E, F.col("score").alias("x"))
    others = table.filter("modelo > 1").select(E, F.col("modelo").alias("contra"), F.col("score").alias("y"))
    return S.spearman(base.join(others, E), "x", "y", ["contra"])


_OBS = f""", obs as (select {P} as fold, modelo as semilla, 'base' as config, ganancia from ranked where puesto = 300
    union all select {P}, modelo, 'corto', ganancia from ranked where puesto = 200
    union all select {P}, modelo, 'largo', ganancia from ranked where puesto = 450),
  d as (select o.config, o.ganancia - b.ganancia as d from obs o join obs b on b.config = 'base' and b.fold = o.fold and b.semilla = o.semilla
    where o.config <> 'base'),
  k as (select *, rank() over (partition by config order by case when d <> 0 then abs(d) end nulls last) + (count(*) over t - 1) / 2.0::double as r, count(*) over t as t
    from d window t as (partition by config, case when d <> 0 then abs(d) end)),
  w as (select config, avg(d) as dif_media, sum(case when d > 0 then 1 else 0 end)::bigint as gana, count(*) as pares, sum(case when d <> 0 then 1 else 0 end)::bigint as n,
    coalesce(sum(case when d > 0 then r end), 0) as wp, coalesce(sum(case when d < 0 then r end), 0) as wm,
    coalesce(sum(case when d <> 0 then t * t - 1.0::double end), 0) as tt from k group by 1)"""


def _observations(spark, folder):
    """Gain by (configuration, fold, seed): folds are periods, seeds are models, configurations are cuts."""
    ranked = R.ranking(scores(spark, folder, True), ["modelo", P])
    name = F.create_map(F.lit(300), F.lit("base"), F.lit(200), F.lit("corto"), F.lit(450), F.lit("largo"))
    return ranked.filter(F.col("puesto").isin(300, 200, 450)).select(
        F.col(P).alias("fold"), F.col("modelo").alias("semilla"), name[F.col("puesto").cast("int")].alias("config"), "ganancia"
    )


@query(
    "paired_signed_rank", "SR6",
    _RANKED_ALL + _OBS + """ select config, dif_media, gana, pares, n, least(wp, wm) as w,
      round((least(wp, wm) - n * (n + 1.0::double) / 4) / nullif(sqrt(n * (n + 1.0::double) * (2 * n + 1) / 24 - tt / 48), 0), 8) as z from w""",
)
def paired_signed_rank(spark, folder):
    return _round(S.paired_comparison(_observations(spark, folder), "base"), 8, "z")


#: The exact p by adding the ranks one by one to the distribution of their sum; the normal p by the series of erf.
_P_SQL = """, o as (select config, cast(2 * r as int) as r2, row_number() over (partition by config order by r) as i from k where d <> 0),
  s as (select config, cast(sum(r2) as int) as total, count(*) as n from o group by 1),
  pasos as (
    with recursive suma as (
      select config, 0 as i, total, list_transform(range(total + 1), lambda x: case when x = 0 then 1.0::double else 0 end) as p from s
      union all
      select u.config, u.i + 1, u.total, list_transform(range(u.total + 1), lambda x: 0.5::double * (u.p[x + 1] + case when x >= o.r2 then u.p[x + 1 - o.r2] else 0 end))
      from suma u join o on o.config = u.config and o.i = u.i + 1)
    select suma.config, suma.p from suma join s on s.config = suma.config and s.n = suma.i),
  z as (select w.*, least(wp, wm) as menor, abs((least(wp, wm) - n * (n + 1.0::double) / 4)
    / nullif(sqrt(n * (n + 1.0::double) * (2 * n + 1) / 24 - tt / 48), 0)) / sqrt(2.0::double) as x from w)
  select z.config, z.n, menor as w, 'exact' as metodo,
    case when z.n = 0 then 1.0::double else round(least(1, 2 * list_sum(p[1:cast(floor(2 * menor + 1e-9) as int) + 1])), 8) end as p
  from z left join pasos on pasos.config = z.config
  union all
  select config, n, menor, 'normal', case when n = 0 then 1.0::double else round(greatest(0, 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(200),
    lambda m: exp((2 * m + 1) * ln(greatest(x, 1e-300)) + 2 * m * ln(2.0::double) + lgamma(m + 1.0::double) - lgamma(2 * m + 2.0::double))))), 8) end from z"""


@query("paired_signed_rank_p", "SR6", _RANKED_ALL + _OBS + _P_SQL)
def paired_signed_rank_p(spark, folder):
    observed = checkpoint(_observations(spark, folder))
    both = S.paired_p_values(observed, "base").unionByName(S.paired_p_values(observed, "base", "normal"))
    return _round(both, 8, "p")


@query(
    "ensemble_against_seeds", "SR9",
    scores_sql() + RANK_FRACTION_SQL + ranked_sql() + f""",
    ens as (select {E}, avg(rango) as score, max(positivo) as positivo from fractions group by 1) {ranked_sql('', 'ens', 'rens')}
    select e.puesto as envios, max(e.ganancia) as ensamble, avg(r.ganancia) as media_semillas, avg(case when r.ganancia < e.ganancia then 1 else 0 end) as superadas
    from rens e join ranked r on r.puesto = e.puesto where e.puesto in ({", ".join(map(str, KS))}) group by 1""",
)
def ensemble_against_seeds(spark, folder):
    table = scores(spark, folder)
    solo = R.ranking(table, ["modelo"]).filter(F.col("puesto").isin(*KS)).select(
        F.col("puesto").alias("envios"), F.col("ganancia").alias("_solo")
    )
    ensemble = R.ranking(R.rank_ensemble(table, keep=["positivo"])).filter(F.col("puesto").isin(*KS)).select(
        F.col("puesto").alias("envios"), F.col("ganancia").alias("_ens")
    )
    return solo.join(ensemble, "envios").groupBy("envios").agg(
        F.max("_ens").alias("ensamble"), F.avg("_solo").alias("media_semillas"),
        F.avg((F.col("_solo") < F.col("_ens")).cast("int")).alias("superadas"),
    )


@query(
    "difference_in_entities", "SR10",
    _RANKED + _DRAWS + f""", d as (select x.publico - y.publico as d from draws x join draws y on x.rep = y.rep and x.modelo = 1 and y.modelo = 2)
    select round(avg(d) / 0.25 / {K.GAIN_HIT + K.COST_MISS}, 8) as dif_clientes, round(stddev_pop(d) / 0.25 / {K.GAIN_HIT + K.COST_MISS}, 8) as sd_clientes,
      round(avg(d) / nullif(stddev_pop(d), 0), 8) as z from d""",
)
def difference_in_entities(spark, folder):
    report = S.difference_report(_draws(spark, folder), "1", "2")
    return _round(report, 8, "dif_clientes", "sd_clientes", "z")


@query(
    "score_auc", "ML14",
    scores_sql(True) + f""", r as (select {P}, modelo, positivo, rank() over (partition by {P}, modelo order by score)
      + (count(*) over (partition by {P}, modelo, score) - 1) / 2.0::double as rk from scores)
    select {P}, modelo, round((sum(case when positivo = 1 then rk else 0 end) - sum(positivo) * (sum(positivo) + 1.0::double) / 2)
      / nullif(sum(positivo)::double * (count(*) - sum(positivo)), 0), 9) as auc from r group by 1, 2""",
)
def score_auc(spark, folder):
    return _round(R.score_auc(scores(spark, folder, True), [P, "modelo"]), 9, "auc")
