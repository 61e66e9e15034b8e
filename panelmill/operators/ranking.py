"""From scores to decisions: rankings, gain and capture curves, cuts, regret, ensembles.

Scores are long tables `(entity, model..., score)`. Every ranking has a total order (score
descending, entity ascending), every alignment is a join on the entity, and a ranking of any
length is numbered and accumulated by `ordered.running_sums`, never in a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators.ordered import RANK_FUNCTIONS, running_sums, value_positions, with_value_ranks

E = K.ENTITY


def contribution(hit: Column) -> Column:
    """What selecting a row earns: the gain of a hit, or minus the cost."""
    return F.when(hit, K.GAIN_HIT).otherwise(-K.COST_MISS).cast("long")


def require_binary(df: DataFrame, column: str) -> None:
    """Fail unless the column is boolean or only holds 0 and 1."""
    kind = dict(df.dtypes)[column]
    if kind == "boolean":
        return
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be boolean or 0 / 1, it is {kind}")
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is not None and (low < 0 or high > 1):
        raise TypeError(f"{column} must be 0 / 1, it spans {low}..{high}")


def ranking(scores: DataFrame, group: Sequence[str] = (), hit: str | None = "positivo") -> DataFrame:
    """Number the rows of each group by score and accumulate gain and hits along the ranking.

    Adds `puesto` and `n`; with `hit`, also `ganancia`, `aciertos` and `positivos`, the hits of
    the whole group.
    """
    one = F.lit(1).cast("long")
    sums = {"puesto": one}
    if hit is not None:
        is_hit = F.col(hit).cast("boolean")
        sums |= {"ganancia": contribution(is_hit), "aciertos": is_hit.cast("long")}
    ranked = running_sums(scores, group, [F.col("score").desc(), F.col(E).asc()], [-F.col("score"), F.col(E)], sums)
    ranked = ranked.withColumnRenamed("puesto_total", "n")
    if hit is None:
        return ranked
    return ranked.withColumnRenamed("aciertos_total", "positivos").withColumnRenamed("ganancia_total", "ganancia_todos")


def top_k(scores: DataFrame, k: int, group: Sequence[str] = ()) -> DataFrame:
    """The k best rows (of each group); ties enter in entity order."""
    return ranking(scores, group, hit=None).filter(F.col("puesto") <= k).drop("puesto", "n")


def cuts(ranked: DataFrame, ks: Sequence[int]) -> DataFrame:
    """The selections of many cuts from one ranking: a row per (cut, selected row)."""
    marks = F.explode(F.array(*[F.lit(k) for k in ks]))
    return ranked.withColumn("corte", marks).filter(F.col("puesto") <= F.col("corte"))


def gain_at(ranked: DataFrame, k: int, group: Sequence[str] = ()) -> DataFrame:
    """(group..., envios, ganancia) at cut k; NULL for a group with fewer than k rows."""
    at = F.max(F.when(F.col("puesto") == k, F.col("ganancia")))
    return ranked.groupBy(*group).agg(F.lit(k).cast("long").alias("envios"), at.alias("ganancia"))


def cut_curve(ranked: DataFrame, start: int, stop: int, step: int, group: Sequence[str] = ()) -> DataFrame:
    """Cumulative gain at start, start + step, ... up to stop or the end of the ranking."""
    at = F.col("puesto")
    return ranked.filter(at.between(start, stop) & ((at - start) % step == 0)).select(
        *group, at.alias("envios"), "ganancia"
    )


def capture_curve(ranked: DataFrame, start: int, stop: int, step: int, group: Sequence[str] = ()) -> DataFrame:
    """Share of all hits found in the top K; does not depend on how many hits there are."""
    at = F.col("puesto")
    return ranked.filter(at.between(start, stop) & ((at - start) % step == 0)).select(
        *group, at.alias("K"), F.try_divide(F.col("aciertos"), F.col("positivos")).alias("captura")
    )


def plateau(curves: DataFrame, tolerance: float = 0.995, rounding: int = 250,
            lowest: int = K.MIN_SELECTED, highest: int = K.MAX_SELECTED) -> DataFrame:
    """(desde, centro, hasta) of the stretch whose mean gain is within tolerance of the best."""
    means = curves.groupBy("envios").agg(F.avg("ganancia").alias("media"))
    best = means.select(F.max("media")).scalar()
    high = means.filter(F.col("media") >= best * F.lit(tolerance))
    ends = high.agg(F.min("envios").alias("desde"), F.max("envios").alias("hasta"))
    middle = F.bround((F.col("desde") + F.col("hasta")) / 2 / rounding) * rounding
    return ends.select(
        "desde", F.greatest(F.least(middle, F.lit(highest)), F.lit(lowest)).cast("long").alias("centro"), "hasta"
    )


def expected_gain(captures: DataFrame, prevalences: Sequence[float]) -> DataFrame:
    """Gain at each K if the month holds this many positives: (prevalencia, K, ganancia)."""
    scenario = F.explode(F.array(*[F.lit(float(p)) for p in prevalences]))
    hits = F.col("captura") * F.col("prevalencia")
    return captures.withColumn("prevalencia", scenario).withColumn(
        "ganancia", hits * K.GAIN_HIT - (F.col("K") - hits) * K.COST_MISS
    )


def regret_on_grid(gains: DataFrame, scenario: Sequence[str], k: str = "K") -> DataFrame:
    """Percent lost at each cut against the scenario's best cut on the grid (>= 0)."""
    best = F.max("ganancia").over(Window.partitionBy(*scenario))
    return gains.select(
        *scenario, k, "ganancia", (100.0 * (best - F.col("ganancia")) / best).alias("regret_pct")
    )


def regret_on_curve(ranked: DataFrame, scenario: Sequence[str], start: int, stop: int, step: int) -> DataFrame:
    """Relative loss at each cut against the best point of the scenario's whole curve (<= 0).

    The best point is an aggregate of the whole ranking; only the grid rows join to it.
    """
    best = ranked.groupBy(*scenario).agg(F.max("ganancia").alias("_mejor"))
    grid = cut_curve(ranked, start, stop, step, scenario)
    return grid.join(best, list(scenario)).select(
        *scenario, "envios", (F.col("ganancia") / F.col("_mejor") - 1).alias("regret")
    )


def worst_and_mean(regrets: DataFrame, k: str, value: str, losses_positive: bool) -> DataFrame:
    """Per cut: the worst scenario and the mean over scenarios."""
    worst = F.max(value) if losses_positive else F.min(value)
    return regrets.groupBy(k).agg(worst.alias("peor"), F.avg(value).alias("medio"))


def minimax_cut(summary: DataFrame, k: str, losses_positive: bool) -> DataFrame:
    """The cut with the smallest worst loss, and the one with the smallest mean loss.

    Ties go to the smaller cut.
    """
    sign = 1 if losses_positive else -1
    first = lambda v: F.min(F.struct(sign * F.col(v), F.col(k))).getField(k)
    return summary.agg(
        first("peor").alias("corte_minimax"),
        first("medio").alias("corte_esperado"),
        (F.min(sign * F.col("peor")) * sign).alias("peor_en_minimax"),
    )


def best_cut(curve: DataFrame, group: Sequence[str] = (), k: str = "envios") -> DataFrame:
    """The cut with the highest gain per group; the smaller cut on a tie."""
    return curve.groupBy(*group).agg(F.max(F.struct("ganancia", (-F.col(k)).alias("_k"))).alias("m")).select(
        *group, (-F.col("m._k")).alias(k), F.col("m.ganancia").alias("ganancia")
    )


def band_rates(ranked: DataFrame, band: int = 1_000, group: Sequence[str] = ()) -> DataFrame:
    """Hit rate of each band of the ranking, against the break-even rate."""
    number = F.ceil(F.col("puesto") / band).cast("long")
    rates = ranked.groupBy(*group, number.alias("banda")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("positivo").cast("boolean")).alias("aciertos")
    )
    rate = F.col("aciertos") / F.col("n")
    return rates.withColumns({"tasa": rate, "rinde": rate >= K.BREAK_EVEN})


def quadratic_vertex(points: DataFrame, x: str, y: str, error: str) -> DataFrame:
    """Vertex of the weighted least-squares parabola through measured points.

    Weights are 1 / error. x is centred and scaled before the normal equations, whose sums
    are one aggregate and whose 3 x 3 solution is closed form.
    """
    spread = points.select(F.avg(x).alias("c"), F.greatest(F.max(x) - F.min(x), F.lit(1)).alias("s"))
    centre, scale = spread.select("c").scalar(), spread.select("s").scalar()
    w, u = F.pow(F.lit(1.0) / F.col(error), F.lit(2)), F.col("_u")
    sums = points.filter(F.col(error) > 0).withColumn("_u", (F.col(x) - centre) / scale).agg(
        *[F.sum(w * F.pow(u, F.lit(p))).alias(f"s{p}") for p in range(5)],
        *[F.sum(w * F.pow(u, F.lit(p)) * F.col(y)).alias(f"t{p}") for p in range(3)],
    )
    s, t = [F.col(f"s{p}") for p in range(5)], [F.col(f"t{p}") for p in range(3)]
    d0, d1, d2 = s[0] * s[2] - s[1] * s[1], s[1] * s[2] - s[0] * s[3], s[1] * s[3] - s[2] * s[2]
    a = d2 * t[0] + d1 * t[1] + d0 * t[2]
    b = (s[2] * s[3] - s[1] * s[4]) * t[0] + (s[0] * s[4] - s[2] * s[2]) * t[1] + d1 * t[2]
    return sums.select((centre + scale * F.try_divide(-b, 2 * a)).alias("vertice"), (a < 0).alias("es_maximo"))


def around_optimum(curve: DataFrame, offsets: Sequence[int], group: Sequence[str] = ()) -> DataFrame:
    """Gain lost by cutting `offset` rows short of or past the best cut."""
    best = best_cut(curve, group)
    shifted = best.select(
        *[F.col(g).alias(f"_{g}") for g in group],
        F.col("envios").alias("optimo"), F.col("ganancia").alias("_mejor"),
        F.explode(F.array(*[F.lit(o) for o in offsets])).alias("desvio"),
    )
    on = F.col("envios") == F.col("optimo") + F.col("desvio")
    for g in group:
        on = on & (F.col(g) == F.col(f"_{g}"))
    return curve.join(shifted, on).select(
        *group, "optimo", "desvio", (F.col("ganancia") - F.col("_mejor")).alias("diferencia")
    )


def push_test(ranked: DataFrame, flag: Column, low: int, high: int, k: int, group: Sequence[str] = ()) -> DataFrame:
    """Gain change at cut k when flagged rows of a band of the ranking move to its front."""
    moved = ranked.select(
        *group, E, "positivo", F.col("puesto").alias("_antes"),
        (F.coalesce(flag, F.lit(False)) & F.col("puesto").between(low, high)).alias("_pasa"),
    )
    hit = F.col("positivo").cast("boolean")
    again = running_sums(
        moved, group, [F.col("_pasa").desc(), F.col("_antes").asc()], [F.when(F.col("_pasa"), 0).otherwise(1), F.col("_antes")],
        {"puesto": F.lit(1).cast("long"), "ganancia": contribution(hit)}, totals=False,
    )
    gains = lambda r, name: r.filter(F.col("puesto") == k).select(*group, F.col("ganancia").alias(name))
    both = gains(ranked, "antes").unionByName(gains(again, "despues"), allowMissingColumns=True)
    return both.groupBy(*group).agg(F.max("antes").alias("antes"), F.max("despues").alias("despues")).withColumn(
        "cambio", F.col("despues") - F.col("antes")
    )


# --- ensembles --------------------------------------------------------------------------------

def fractional_ranks(scores: DataFrame, model: Sequence[str] = ("modelo",), name: str = "rango") -> DataFrame:
    """Average-tie rank of the score inside its model, as a fraction of the rows."""
    return with_value_ranks(scores, list(model), "score", {name: "rank_fraction"})


def rank_ensemble(scores: DataFrame, by: Sequence[str] = (), model: Sequence[str] = ("modelo",),
                  keep: Sequence[str] = ()) -> DataFrame:
    """Mean fractional rank over models: positions are comparable, probabilities are not."""
    ranks = fractional_ranks(scores, model)
    return ranks.groupBy(E, *by, *keep).agg(F.avg("rango").alias("score"))


def alignment(left: DataFrame, right: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """How many entities both tables hold, and how many only one of them."""
    keys = [*group, E]
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full")
    return both.groupBy(*group).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("en_ambas"),
        F.count_if(F.col("_b").isNull()).alias("solo_izquierda"),
        F.count_if(F.col("_a").isNull()).alias("solo_derecha"),
    )


def require_aligned(left: DataFrame, right: DataFrame) -> None:
    row = alignment(left, right).first()
    if row.solo_izquierda or row.solo_derecha:
        raise ValueError(f"score tables hold different entities: {row.asDict()}")


def weighted_mix(first: DataFrame, second: DataFrame, weight: float, model: Sequence[str] = ("modelo",)) -> DataFrame:
    """(1 - weight) of one fractional rank plus weight of another, joined on model and entity."""
    a = fractional_ranks(first, model, "_r1").select(E, *model, "_r1")
    b = fractional_ranks(second, model, "_r2").select(E, *model, "_r2")
    return a.join(b, [E, *model]).withColumn(
        "score", F.lit(1.0 - weight) * F.col("_r1") + F.lit(float(weight)) * F.col("_r2")
    )


def overlap(selected: DataFrame, reference: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of a selection that a reference selection also holds, and how many change."""
    marked = selected.select(*group, E).join(
        reference.select(E).distinct().withColumn("_en", F.lit(1)), E, "left"
    )
    return marked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("elegidos"), F.count("_en").alias("comunes"),
        (F.count(F.lit(1)) - F.count("_en")).alias("cambian"),
        (F.count("_en") / F.count(F.lit(1))).alias("solape"),
    )


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entities in only one of two selections, with the side."""
    a, b = left.select(E).distinct(), right.select(E).distinct()
    return (
        a.join(b, E, "left_anti").withColumn("lado", F.lit("izquierda"))
        .unionByName(b.join(a, E, "left_anti").withColumn("lado", F.lit("derecha")))
    )


def votes(selections: DataFrame) -> DataFrame:
    """How many entities are in exactly v of the selections."""
    per_entity = selections.groupBy(E).agg(F.count(F.lit(1)).alias("listas"))
    return per_entity.groupBy("listas").agg(F.count(F.lit(1)).alias("clientes"))


def selection_agreement(ranked: DataFrame, k: int, models: int) -> DataFrame:
    """Positives that all, some or none of the models select."""
    per_positive = ranked.filter(F.col("positivo").cast("boolean")).groupBy(E).agg(
        F.count_if(F.col("puesto") <= k).alias("v")
    )
    kind = F.when(F.col("v") == 0, "ninguno").when(F.col("v") == models, "todos").otherwise("algunos")
    return per_positive.groupBy(kind.alias("lo_mandan")).agg(F.count(F.lit(1)).alias("positivos"))


def seed_statistics(observations: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, both standard deviations, standard error and count over seeds."""
    return observations.groupBy(*group).agg(
        F.avg(value).alias("media"), F.stddev_pop(value).alias("sd_poblacion"), F.stddev(value).alias("sd_muestra"),
        (F.stddev(value) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("error"), F.count(F.lit(1)).alias("n"),
    )


def score_auc(scores: DataFrame, group: Sequence[str] = ("modelo",)) -> DataFrame:
    """Exact AUC of a score per group from average ranks of distinct scores."""
    return auc_from_values(scores, group, "score", F.col("positivo").cast("int"))


def auc_from_values(df: DataFrame, group: Sequence[str], value: str, y: Column, name: str = "auc") -> DataFrame:
    runs = value_positions(df, group, value, {"pos": F.sum(y)})
    n1, n = F.max("pos_total"), F.max("n")
    rank_sum = F.sum(F.col("pos") * RANK_FUNCTIONS["rank_average"]())
    return runs.groupBy(*group).agg(
        F.try_divide(rank_sum - n1 * (n1 + 1) / 2, (n1 * (n - n1)).cast("double")).alias(name)
    )


def selection_guard(selected: DataFrame, population: DataFrame, markers: Mapping[str, str], minimum_lift: float = 2.0) -> DataFrame:
    """Are the selected rows enriched in known risk markers? One row per marker.

    `valida` is true only when every selected entity is in the population, all lifts are
    finite and the best one reaches the minimum: unknown values make it false.
    """
    chosen = selected.select(E).distinct()
    marked = population.join(chosen.withColumn("_sel", F.lit(True)), E, "left")
    sel = F.col("_sel").isNotNull()
    wide = marked.agg(
        F.count_if(sel).alias("cubiertos"), F.count_if(~sel).alias("resto"),
        *[F.count_if(sel & F.coalesce(F.expr(c), F.lit(False))).alias(f"s~{m}") for m, c in markers.items()],
        *[F.count_if(~sel & F.coalesce(F.expr(c), F.lit(False))).alias(f"r~{m}") for m, c in markers.items()],
    )
    asked = chosen.select(F.count(F.lit(1))).scalar()
    rows = wide.select(
        "cubiertos", "resto",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("marcador"), F.col(f"s~{m}").alias("s"), F.col(f"r~{m}").alias("r"))
            for m in markers
        ])).alias("m"),
    )
    p_sel, p_rest = F.try_divide(F.col("m.s"), F.col("cubiertos")), F.try_divide(F.col("m.r"), F.col("resto"))
    every = Window.partitionBy("cubiertos")
    table = rows.select(
        F.col("m.marcador").alias("marcador"), "cubiertos", p_sel.alias("p_elegidos"), p_rest.alias("p_resto"),
        F.try_divide(p_sel, p_rest).alias("lift"), (F.col("cubiertos") == asked).alias("cobertura_total"),
    )
    sure = F.min(F.col("lift").isNotNull().cast("int")).over(every) == 1
    return table.withColumn(
        "valida", F.coalesce(F.col("cobertura_total") & sure & (F.max("lift").over(every) >= minimum_lift), F.lit(False))
    )


def require_valid_selection(report: DataFrame) -> None:
    rows = report.collect()
    if not rows or not all(r.valida for r in rows):
        raise ValueError(f"selection does not stand out from the population: {[r.asDict() for r in rows]}")
