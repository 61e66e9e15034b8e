"""Repeated draws, bootstrap and paired statistics.

Only selected rows can contribute to a gain, so draws multiply the selection, not the
population, and each (draw) sum combines map-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.draws import poisson_one, uniform
from panelmill.operators.ordered import with_value_ranks
from panelmill.operators.ranking import contribution
from panelmill.session import broadcast_if_small

E = K.ENTITY


def with_draws(df: DataFrame, repetitions: int, name: str = "rep") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def public_draws(selected: DataFrame, repetitions: int, share: float = 0.25, group: Sequence[str] = ()) -> DataFrame:
    """Gain of a selection on repeated random shares of the month: (group, rep, publico, privado)."""
    drawn = with_draws(selected, repetitions).withColumn("_pub", uniform(E, "rep") < share)
    gain = contribution(F.col("positivo").cast("boolean"))
    return drawn.groupBy(*group, "rep").agg(
        F.sum(F.when(F.col("_pub"), gain).otherwise(0)).alias("publico"),
        F.sum(F.when(F.col("_pub"), 0).otherwise(gain)).alias("privado"),
    )


#: Bands of the unit interval in which the numbers of a draw are counted.
BANDS = 1024


def exact_public_draws(population: DataFrame, repetitions: int, k: int, share: float = 0.25) -> DataFrame:
    """The same with exactly round(share * n) rows of the population in each draw.

    `population` carries `puesto`; rows outside the top k earn nothing but take up places. The numbers of each
    draw are counted in bands on the map side. All rows below the band with the cut are in; only that band's rows,
    one in BANDS, are shuffled and put in order.
    """
    number = uniform(E, "rep")
    drawn = with_draws(population.select(E, "positivo", "puesto"), repetitions).withColumn("_u", number)
    drawn = drawn.withColumn("_band", F.least(F.floor(F.col("_u") * BANDS), F.lit(BANDS - 1)))
    bands = drawn.groupBy("rep", "_band").agg(F.count(F.lit(1)).alias("_n"))
    of_draw = Window.partitionBy("rep")
    upto = F.sum("_n").over(of_draw.orderBy("_band"))
    wanted = F.bround(F.sum("_n").over(of_draw) * share)
    cuts = bands.select("rep", "_band", (upto - F.col("_n")).alias("_below"), upto.alias("_upto"), wanted.alias("_wanted")).filter(
        "_below <= _wanted and (_upto > _wanted or _band = {0})".format(BANDS - 1)
    ).groupBy("rep").agg(F.min_by(F.struct("_band", (F.col("_wanted") - F.col("_below")).alias("_rest"), "_wanted"), "_band").alias("_cut"))
    cuts = broadcast_if_small(cuts.select(F.col("rep").alias("_r"), "_cut.*").withColumnRenamed("_band", "_at"))  # one row per draw
    gain = F.when(F.col("puesto") <= k, contribution(F.col("positivo").cast("boolean"))).otherwise(0)
    placed = drawn.join(cuts, F.col("rep") == F.col("_r"))
    whole = placed.filter("_band < _at and puesto <= {0}".format(k)).select("rep", gain.alias("g"))
    order = Window.partitionBy("rep").orderBy("_u", E)
    edge = placed.filter("_band = _at").withColumn("_rn", F.row_number().over(order)).filter("_rn <= _rest").select("rep", gain.alias("g"))
    none = cuts.select(F.col("_r").alias("rep"), F.lit(0).cast("long").alias("g"), "_wanted")
    rows = whole.unionByName(edge).withColumn("_wanted", F.lit(None).cast("double")).unionByName(none.withColumn("_wanted", F.col("_wanted").cast("double")))
    return rows.groupBy("rep").agg(F.sum("g").alias("publico"), F.max("_wanted").cast("long").alias("sorteados"))


def paired_draws(draws: DataFrame, pairs: Sequence[tuple[str, str]], truth: DataFrame, model: str = "modelo",
                 share: float = 0.25) -> DataFrame:
    """Pairs of configurations compared on shared draws.

    Mean and sd of the public difference, sd of the scaled-up estimate, and the share of draws
    that order the two as the whole month does. `truth` is (model, total).
    """
    names = sorted({m for pair in pairs for m in pair})
    wide = draws.groupBy("rep").pivot(model, names).agg(F.sum("publico"))
    total = truth.groupBy().pivot(model, names).agg(F.sum("total"))
    real = {m: total.select(m).scalar() for m in names}
    rows = wide.select(
        F.explode(F.array(*[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) - F.col(b)).alias("d"), (real[a] - real[b]).alias("real")
            )
            for a, b in pairs
        ])).alias("p")
    ).select("p.*")
    return rows.groupBy("a", "b").agg(
        F.max("real").alias("dif_real"),
        F.avg("d").alias("dif_publica_media"),
        F.stddev_pop("d").alias("sd_dif_publica"),
        (F.stddev_pop("d") / share).alias("sd_estimador"),
        F.avg((F.signum("d") == F.signum("real")).cast("int")).alias("acierta_el_orden"),
    )


def argmax_bias(ranked: DataFrame, step: int, stop: int, repetitions: int, share: float = 0.25) -> DataFrame:
    """Where the public curve of each draw peaks, and what following it earns on the rest.

    Rows are summed per (draw, band of the ranking); curves are running sums over bands.
    """
    band = (F.ceil(F.col("puesto") / step) * step).cast("long")
    gain = contribution(F.col("positivo").cast("boolean"))
    drawn = with_draws(ranked.filter(F.col("puesto") <= stop).withColumns({"K": band, "_g": gain}), repetitions)
    public = uniform(E, "rep") < share
    sums = drawn.groupBy("rep", "K").agg(
        F.sum(F.when(public, F.col("_g")).otherwise(0)).alias("pub"), F.sum("_g").alias("todo")
    )
    along = Window.partitionBy("rep").orderBy("K").rowsBetween(Window.unboundedPreceding, 0)
    curves = sums.select(
        "rep", "K", F.sum("pub").over(along).alias("pub"), F.sum("todo").over(along).alias("todo")
    )
    return curves.groupBy("rep").agg(
        F.max(F.struct("pub", (-F.col("K")).alias("_k"), (F.col("todo") - F.col("pub")).alias("priv"))).alias("m"),
        F.max(F.struct("todo", (-F.col("K")).alias("_k"))).alias("t"),
    ).select(
        "rep", (-F.col("m._k")).alias("k_publico"), F.col("m.priv").alias("privado_en_argmax"),
        (-F.col("t._k")).alias("k_real"),
    )


def bootstrap_difference(first: DataFrame, second: DataFrame, repetitions: int) -> DataFrame:
    """Entity bootstrap of the gain difference of two selections: one Poisson(1) weight per entity and draw.

    Entities that both select cancel, so only the ones that differ are drawn.
    """
    gain = contribution(F.col("positivo").cast("boolean"))
    signed = first.select(E, gain.alias("g")).unionByName(second.select(E, (-gain).alias("g")))
    differing = signed.groupBy(E).agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    weight = poisson_one(uniform(E, F.col("rep"), F.lit("b")))
    drawn = with_draws(differing, repetitions).groupBy("rep").agg(F.sum(F.col("g") * weight).alias("diferencia"))
    return drawn


def interval(draws: DataFrame, value: str = "diferencia", digits: int = 4) -> DataFrame:
    """Mean, sd and 95 % interval over draws (as many rows as draws)."""
    return draws.agg(
        F.round(F.avg(value), digits).alias("media"), F.round(F.stddev_pop(value), digits).alias("sd"),
        F.round(F.percentile(value, 0.025), digits).alias("desde"),
        F.round(F.percentile(value, 0.975), digits).alias("hasta"), F.count(F.lit(1)).alias("repeticiones"),
    )


def spearman(pairs: DataFrame, x: str, y: str, group: Sequence[str] = (), digits: int = 8) -> DataFrame:
    """Rank correlation per group: average-tie ranks, then their correlation."""
    keyed = pairs if group else pairs.withColumn("_g", F.lit(0))
    by = list(group) or ["_g"]
    ranked = with_value_ranks(keyed, by, x, {"_rx": "rank_average"})
    ranked = with_value_ranks(ranked, by, y, {"_ry": "rank_average"})
    out = ranked.groupBy(*by).agg(F.round(F.corr("_rx", "_ry"), digits).alias("rho"), F.count(F.lit(1)).alias("n"))
    return out if group else out.drop("_g")


def _signed_ranks(observations: DataFrame, base: str, config: str, keys: Sequence[str], value: str) -> DataFrame:
    """Differences to `base` with the average-tie rank of their size; a configuration has one row per fold and seed."""
    ref = observations.filter(F.col(config) == base).select(*keys, F.col(value).alias("_base"))
    diffs = observations.filter(F.col(config) != base).join(ref, list(keys)).select(
        config, *keys, (F.col(value) - F.col("_base")).alias("d")
    )
    sized = diffs.withColumn("_abs", F.when(F.col("d") != 0, F.abs("d")))
    rank = F.rank().over(Window.partitionBy(config).orderBy(F.col("_abs").asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(config, "_abs"))
    return sized.withColumns({"_rank": rank + (ties - 1) / 2, "_ties": ties})


def _signed_rank_statistics(ranked: DataFrame, config: str) -> DataFrame:
    used = F.col("_abs").isNotNull()
    stats = ranked.groupBy(config).agg(
        F.avg("d").alias("dif_media"),
        F.count_if(F.col("d") > 0).alias("gana"),
        F.count(F.lit(1)).alias("pares"),
        F.count_if(used).alias("n"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("_rank"))), F.lit(0.0)).alias("w_mas"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("_rank"))), F.lit(0.0)).alias("w_menos"),
        F.coalesce(F.sum(F.when(used, F.pow("_ties", F.lit(2)) - 1)), F.lit(0.0)).alias("_t"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48
    w = F.least("w_mas", "w_menos")
    return stats.select(
        config, "dif_media", "gana", "pares", "n", w.alias("w"),
        F.try_divide(w - n * (n + 1) / 4, F.sqrt(variance)).alias("z"),
    )


def paired_comparison(observations: DataFrame, base: str, config: str = "config", keys: Sequence[str] = ("fold", "semilla"),
                      value: str = "ganancia") -> DataFrame:
    """Each configuration against `base` by (fold, seed): mean difference, wins, signed-rank statistic."""
    return _signed_rank_statistics(_signed_ranks(observations, base, config, keys, value), config)


def _exact_p(doubled: Column, w: Column) -> Column:
    """Two-sided p of the signed-rank statistic: the share of sign patterns whose rank sum is at most w, twice.

    `doubled` holds twice the rank of each non-zero difference (whole numbers, ties included).
    """
    total = F.aggregate(doubled, F.lit(0), lambda a, r: a + r)
    start = F.transform(F.sequence(F.lit(0), total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def half(ways: Column, rank: Column) -> Column:
        return F.transform(ways, lambda p, s: 0.5 * (p + F.coalesce(F.when(s >= rank, F.get(ways, s - rank)), F.lit(0.0))))

    ways = F.aggregate(doubled, start, half)
    low = F.slice(ways, 1, (F.floor(2 * w + 1e-9) + 1).cast("int"))
    return F.least(F.lit(1.0), 2 * F.aggregate(low, F.lit(0.0), lambda a, p: a + p))


def _normal_p(z: Column) -> Column:
    """Two-sided p of a normal score: 1 - erf(|z| / sqrt 2), by the series of positive terms."""
    x = F.abs(z) / math.sqrt(2)
    start = F.struct(x.alias("term"), x.alias("sum"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step)["sum"]
    return F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series)


def paired_p_values(observations: DataFrame, base: str, method: str = "exact", config: str = "config",
                    keys: Sequence[str] = ("fold", "semilla"), value: str = "ganancia") -> DataFrame:
    """(config, n, w, metodo, p): two-sided signed-rank p against `base`, by the method asked for at every n.

    "exact" counts sign patterns over the ranks of the (fold, seed) grid, "normal" uses the normal score with
    ties corrected. Without any difference p is 1.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method: {method}")
    ranked = _signed_ranks(observations, base, config, keys, value)
    stats = _signed_rank_statistics(ranked, config)
    if method == "normal":
        p = F.when(F.col("n") == 0, 1.0).otherwise(_normal_p(F.col("z")))
        return stats.select(config, "n", "w", F.lit(method).alias("metodo"), p.alias("p"))
    ranks = ranked.filter("_abs is not null").groupBy(F.col(config).alias("_c")).agg(
        F.sort_array(F.collect_list((2 * F.col("_rank")).cast("int"))).alias("_doubled")
    )
    p = F.when(F.col("n") == 0, 1.0).otherwise(_exact_p(F.col("_doubled"), F.col("w")))
    return stats.join(ranks, F.col(config).eqNullSafe(F.col("_c")), "left").select(config, "n", "w", F.lit(method).alias("metodo"), p.alias("p"))


def difference_report(draws: DataFrame, a: str, b: str, model: str = "modelo", share: float = 0.25) -> DataFrame:
    """The difference of two selections in entities, its sd over shared draws, and z."""
    per_hit = float(K.GAIN_HIT + K.COST_MISS)
    wide = draws.groupBy("rep").pivot(model, [a, b]).agg(F.sum(F.col("publico")), ).select(
        "rep", (F.col(a) - F.col(b)).alias("d")
    )
    mean, sd = F.avg("d"), F.stddev_pop("d")
    return wide.agg(
        (mean / share / per_hit).alias("dif_clientes"), (sd / share / per_hit).alias("sd_clientes"),
        F.try_divide(mean, sd).alias("z"),
    )
