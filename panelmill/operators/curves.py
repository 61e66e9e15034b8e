"""Decisions over every cut of a ranking: optimum, plateau, regret and minimax, without a grid.

A ranking is cut into blocks that follow its order (`ordered`), or at fixed places once rows are numbered. A block is summed up as
(sum, best running sum, place of the best), which merges: the best cut of two neighbouring blocks is the first one's, or the second one's
after the first one's sum. So the exact optimum over all places comes from the small block table, and no row ever learns its running sum
for it. Curves that are averaged over models or compared over scenarios are aggregates by place; what is kept of them is one row or
the places of display, `parts` equal shares of a ranking's length, whatever that is.

The smallest cut wins ties everywhere. Places that a shorter ranking does not have are left out of means and comparisons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.draws import uniform
from panelmill.operators.ordered import _KEY, _ONE, _TWO, _blocks, _in_blocks
from panelmill.operators.ranking import contribution
from panelmill.session import checkpoint

E = K.ENTITY
#: Rows of a block of a numbered ranking.
BLOCK = 512


def best_cuts(scores: DataFrame, group: Sequence[str] = (), hit: str = "positivo") -> DataFrame:
    """(group..., envios, ganancia, n): the cut of each group with the highest gain, over all places of its ranking."""
    group = list(group)
    rows = _in_blocks(scores.withColumn("_g", contribution(F.col(hit).cast("boolean"))), group, -F.col("score"), F.col(E))
    inside = Window.partitionBy(_KEY).orderBy(F.col("score").desc(), F.col(E).asc())
    local = rows.withColumns({"_sum": F.sum("_g").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_at": F.row_number().over(inside)})
    blocks = local.groupBy(_KEY).agg(
        F.sum("_g").alias("_total"), F.count(F.lit(1)).alias("_rows"), F.max(F.struct("_sum", (-F.col("_at")).alias("back"))).alias("_best")
    )
    names = [F.col(f"{_KEY}.{c}").alias(c) for c in group]
    before = Window.partitionBy(*[F.col(f"{_KEY}.{c}") for c in group]).orderBy(f"{_KEY}.{_ONE}", f"{_KEY}.{_TWO}").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = blocks.select(
        *names, "_rows", F.struct((offset("_total") + F.col("_best._sum")).alias("ganancia"), (F.col("_best.back") - offset("_rows")).alias("back")).alias("m")
    )
    best = placed.groupBy(*group).agg(F.max("m").alias("m"), F.sum("_rows").alias("n"))
    return best.filter("n > 0").select(*group, (-F.col("m.back")).cast("long").alias("envios"), F.col("m.ganancia").alias("ganancia"), "n")


def on_display(parts: int, place: str = "puesto", n: str = "n") -> Column:
    """Whether a place ends one of `parts` equal shares of the ranking; the last place always does."""
    share = lambda at: F.floor(at * parts / F.col(n))
    return share(F.col(place)) > share(F.col(place) - 1)


def display(ranked: DataFrame, parts: int) -> DataFrame:
    """The rows of a ranking (`puesto`, `n`) at the places of display."""
    return ranked.filter(on_display(parts))


def mean_curve(ranked: DataFrame, value: Column, group: Sequence[str], name: str) -> DataFrame:
    """(K, name, n) at every place: the mean of a value over the groups, up to the end of the shortest ranking. Materialised once."""
    present = ranked.select(F.countDistinct(F.struct(*group))).scalar()
    means = ranked.groupBy(F.col("puesto").alias("K")).agg(F.avg(value).alias(name), F.count(F.lit(1)).alias("_groups"), F.min("n").alias("n"))
    return checkpoint(means.filter(F.col("_groups") == present).drop("_groups"))


def plateau(means: DataFrame, tolerance: float = 0.995, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(mejor, desde, centro, hasta) of a mean gain curve (K, ganancia, n): the best cut, and the stretch whose gain is within tolerance of it.

    The centre is kept between the shares `low` and `high` of the ranking.
    """
    best = means.agg(F.max(F.struct("ganancia", (-F.col("K")).alias("back"))).alias("m"), F.max("K").alias("n"))
    top = best.select("m.ganancia").scalar()
    ends = means.filter(F.col("ganancia") >= top * F.lit(tolerance)).agg(F.min("K").alias("desde"), F.max("K").alias("hasta"))
    n = F.col("n")
    middle = F.floor((F.col("desde") + F.col("hasta")) / 2)
    return ends.crossJoin(F.broadcast(best)).select(
        (-F.col("m.back")).alias("mejor"), "desde", F.greatest(F.least(middle, F.floor(n * high)), F.floor(n * low)).alias("centro"), "hasta"
    )


def scenario_losses(captures: DataFrame, prevalences: Sequence[float]) -> DataFrame:
    """(K, n, ganancias, perdidas, peor, medio) of a mean capture curve (K, captura, n), at every place.

    The gain if a month holds so many positives, and the percentage lost against the best of all places; worst and mean loss over the scenarios.
    """
    hits = lambda p: F.col("captura") * F.lit(float(p))
    gains = captures.withColumn("ganancias", F.array(*[hits(p) * K.GAIN_HIT - (F.col("K") - hits(p)) * K.COST_MISS for p in prevalences]))
    best = gains.select(F.array(*[F.max(F.get("ganancias", F.lit(i))) for i in range(len(prevalences))])).scalar()
    lost = F.array(*[100.0 * (F.get(best, F.lit(i)) - F.get("ganancias", F.lit(i))) / F.get(best, F.lit(i)) for i in range(len(prevalences))])
    total = F.aggregate("perdidas", F.lit(0.0), lambda s, x: s + x)
    return gains.withColumn("perdidas", lost).select(
        "K", "n", "ganancias", "perdidas", F.array_max("perdidas").alias("peor"), (total / len(prevalences)).alias("medio")
    )


def curve_losses(ranked: DataFrame, scenario: Sequence[str]) -> DataFrame:
    """The rows of a ranking with `regret`, the relative loss (<= 0) against the best place of their scenario."""
    best = ranked.groupBy(*[F.col(c).alias(f"_{c}") for c in scenario]).agg(F.max("ganancia").alias("_mejor"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in scenario]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return ranked.join(best, on).withColumn("regret", F.col("ganancia") / F.col("_mejor") - 1).drop("_mejor", *[f"_{c}" for c in scenario])


def minimax(summary: DataFrame, k: str, losses_positive: bool) -> DataFrame:
    """The cut with the smallest worst loss and the one with the smallest mean loss, over every place of `summary` (k, peor, medio)."""
    sign = 1 if losses_positive else -1
    least = lambda v: F.min(F.struct((sign * F.col(v)).alias("v"), F.col(k).alias("k")))
    both = summary.agg(least("peor").alias("a"), least("medio").alias("b"))
    return both.select(F.col("a.k").alias("corte_minimax"), F.col("b.k").alias("corte_esperado"), (F.col("a.v") * sign).alias("peor_en_minimax"))


def draw_sums(ranked: DataFrame, repetitions: int, share: float = 0.25) -> DataFrame:
    """(rep, block, pub, all, best, best_k, rest, top, top_k): each block of a numbered ranking summed up once for each draw.

    A block is shuffled once, as a list in order. A row's number is drawn once per draw, before the sums, which use what it earns in
    public several times. The blocks stay spread, however few bytes they have: the draws multiply their work.
    """
    gain = contribution(F.col("positivo").cast("boolean"))
    row = F.struct(F.col("puesto").cast("long").alias("k"), F.col(E).alias("e"), gain.alias("g"))
    numbered = ranked.select(F.floor((F.col("puesto") - 1) / BLOCK).alias("block"), row.alias("row"))
    blocks = numbered.repartition(_blocks(ranked.sparkSession), "block").groupBy("block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    drawn = blocks.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    state = "struct<pub: long, all: long, best: long, best_k: long, rest: long, top: long, top_k: long>"
    low = -(2**62)
    start = F.struct(*[F.lit(v).cast("long") for v in (0, 0, low, 0, 0, low, 0)]).cast(state)

    def draw(r: Column) -> Column:
        return F.struct(r["k"].alias("k"), r["g"].alias("g"), F.when(uniform(r["e"], "rep") < share, r["g"]).otherwise(F.lit(0)).cast("long").alias("p"))

    def add(s: Column, r: Column) -> Column:
        pub, whole = s["pub"] + r["p"], s["all"] + r["g"]
        peak, real = pub > s["best"], whole > s["top"]
        return F.struct(
            pub.alias("pub"), whole.alias("all"), F.when(peak, pub).otherwise(s["best"]).alias("best"), F.when(peak, r["k"]).otherwise(s["best_k"]).alias("best_k"),
            F.when(peak, whole - pub).otherwise(s["rest"]).alias("rest"), F.when(real, whole).otherwise(s["top"]).alias("top"), F.when(real, r["k"]).otherwise(s["top_k"]).alias("top_k"),
        )

    return drawn.select("rep", "block", F.aggregate(F.transform("rows", draw), start, add).alias("s")).select("rep", "block", "s.*")


def draw_optima(ranked: DataFrame, repetitions: int, share: float = 0.25) -> DataFrame:
    """(rep, k_publico, privado_en_argmax, k_real): where the public curve of each draw peaks over all places, and what following it earns on the rest."""
    sums = checkpoint(draw_sums(ranked, repetitions, share))
    before = Window.partitionBy("rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    pub, whole = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("pub", "all"))
    placed = sums.select(
        "rep", F.struct((pub + F.col("best")).alias("v"), (-F.col("best_k")).alias("back"), (whole - pub + F.col("rest")).alias("rest")).alias("p"),
        F.struct((whole + F.col("top")).alias("v"), (-F.col("top_k")).alias("back")).alias("t"),
    )
    return placed.groupBy("rep").agg(F.max("p").alias("p"), F.max("t").alias("t")).select(
        "rep", (-F.col("p.back")).alias("k_publico"), F.col("p.rest").alias("privado_en_argmax"), (-F.col("t.back")).alias("k_real")
    )
