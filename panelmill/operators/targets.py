"""Targets, weights, samples and folds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.draws import uniform
from panelmill.functions.period import periods_between
from panelmill.operators.ordered import row_numbers

E, P, L = K.ENTITY, K.PERIOD, K.LABEL
Y, WEIGHT = "clase_binaria", "peso"
#: Prefix of the noise columns.
NOISE = "ruido"


def target(kind: str) -> Column:
    """0 / 1 target: one class alone, or both classes of leavers. Unlabelled rows are 0."""
    classes = {
        "baja1": [K.LEAVES_NEXT],
        "baja2": [K.LEAVES_IN_TWO],
        "baja12": [K.LEAVES_NEXT, K.LEAVES_IN_TWO],
        "pesos": [K.LEAVES_NEXT, K.LEAVES_IN_TWO],
    }
    if kind not in classes:
        raise ValueError(f"unknown target: {kind!r}")
    return F.when(F.col(L).isin(*classes[kind]), 1).otherwise(0)


def prepare(panel: DataFrame, periods: Iterable[int], kind: str = "baja2", weight_next: float = 0.0) -> DataFrame:
    """Rows of the periods with target and weight; "pesos" gives the nearer class its own weight."""
    weight = F.lit(1.0)
    if kind == "pesos":
        weight = F.when(F.col(L) == K.LEAVES_NEXT, F.lit(float(weight_next))).otherwise(1.0)
    return panel.filter(F.col(P).isin(*periods)).withColumns({Y: target(kind), WEIGHT: weight})


def decayed(prepared: DataFrame, rate: float, newest: int) -> DataFrame:
    """Multiply the weight by rate ** (months before the newest training period)."""
    age = periods_between(F.col(P), F.lit(newest))
    return prepared.withColumn(WEIGHT, F.pow(F.lit(float(rate)), age) * F.col(WEIGHT))


def match_positives(panel: DataFrame, period: int, like: int, seed: int, positive: str = K.LEAVES_IN_TWO) -> DataFrame:
    """Rows of a period with positives dropped at random until there are as many as in another period."""
    wanted = panel.filter((F.col(P) == like) & (F.col(L) == positive)).select(F.count(F.lit(1))).scalar()
    rows = panel.filter(F.col(P) == period)
    is_positive = F.coalesce(F.col(L) == positive, F.lit(False))
    shuffled = rows.filter(is_positive).withColumn("_u", uniform(E, P, seed))
    kept = (
        row_numbers(shuffled, [P], [F.col("_u").asc(), F.col(E).asc()], [F.col("_u"), F.col(E)], "_rn", "_n")
        .filter(F.col("_rn") <= wanted).drop("_u", "_rn", "_n")
    )
    return rows.filter(~is_positive).unionByName(kept)


def partially_labelled(panel: DataFrame, full: Sequence[int], partial: int, weight_next: float = 0.25) -> DataFrame:
    """Training rows in which the newest month only knows who left at once.

    Its other positives are hidden as negatives of weight 1, as they would be in real use.
    """
    rows = prepare(panel, [*full, partial], "pesos", weight_next)
    hidden = (F.col(P) == partial) & F.coalesce(F.col(L) == K.LEAVES_IN_TWO, F.lit(False))
    return rows.withColumns({
        Y: F.when(hidden, 0).otherwise(F.col(Y)), WEIGHT: F.when(hidden, 1.0).otherwise(F.col(WEIGHT))
    })


def append_unlabelled(labelled: DataFrame, unlabelled: DataFrame, suspects: DataFrame, weight: float) -> DataFrame:
    """Add a month that only knows one class: its positives enter, top-ranked unlabelled rows do not.

    `suspects` holds the entities at the top of a ranking of that month.
    """
    is_positive = F.coalesce(F.col(L) == K.LEAVES_NEXT, F.lit(False))
    rows = unlabelled.withColumns({
        Y: is_positive.cast("int"), WEIGHT: F.when(is_positive, F.lit(float(weight))).otherwise(1.0)
    })
    negatives = rows.filter(F.col(Y) == 0).join(suspects.select(E).distinct(), E, "left_anti")
    return labelled.unionByName(rows.filter(F.col(Y) == 1)).unionByName(negatives.select(rows.columns))


@dataclass(frozen=True)
class Fold:
    """Train on some periods, validate on a later one; `positive` is the class validated."""

    name: str
    train: tuple[int, ...]
    validation: int
    positive: str = K.LEAVES_IN_TWO

    def gap(self) -> int:
        last = max(self.train)
        return (self.validation // 100 - last // 100) * 12 + self.validation % 100 - last % 100

    def checked(self, minimum: int = 2) -> Fold:
        if self.gap() < minimum:
            raise ValueError(
                f"fold {self.name}: validation {self.validation} is {self.gap()} month(s) after the newest training "
                f"month; its positives would already be positives in training"
            )
        return self


def assign_folds(panel: DataFrame, folds: Sequence[Fold], minimum_gap: int = 2) -> DataFrame:
    """One row per (fold, role, panel row): a walk-forward design without a loop over folds."""
    roles = [
        F.struct(F.lit(f.name).alias("fold"), F.lit(role).alias("rol"), F.lit(p).alias("_p"), F.lit(f.positive).alias("positiva"))
        for f in (fold.checked(minimum_gap) for fold in folds)
        for role, periods in (("entrenamiento", f.train), ("validacion", (f.validation,)))
        for p in periods
    ]
    mine = F.filter(F.array(*roles), lambda r: r["_p"] == F.col(P))
    return panel.withColumn("_r", F.explode(mine)).withColumns({
        "fold": F.col("_r.fold"), "rol": F.col("_r.rol"),
        Y: F.coalesce(F.col(L) == F.col("_r.positiva"), F.lit(False)).cast("int"),
    }).drop("_r")


def leak_audit(panel: DataFrame, links: Sequence[tuple[tuple[int, ...], int]], train_class: str = K.LEAVES_IN_TWO,
               validation_class: str = K.LEAVES_NEXT) -> DataFrame:
    """Share of validation positives whose entity already is a training positive, per link."""
    def marked(cls: str, pairs: list[tuple[int, int]]) -> DataFrame:
        ids = F.filter(
            F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in pairs]), lambda r: r["p"] == F.col(P)
        )
        return panel.filter(F.col(L) == cls).select(E, F.explode(ids).alias("r")).select(E, F.col("r.i").alias("eslabon"))

    train = marked(train_class, [(i, p) for i, (ps, _) in enumerate(links) for p in ps]).distinct()
    validation = marked(validation_class, [(i, v) for i, (_, v) in enumerate(links)])
    names = F.element_at(F.array(*[F.lit(v) for _, v in links]), F.col("eslabon") + 1)
    return (
        validation.join(train.withColumn("_en", F.lit(1)), [E, "eslabon"], "left")
        .groupBy(names.alias("validacion"))
        .agg(F.count(F.lit(1)).alias("positivos"), F.count("_en").alias("ya_en_entrenamiento"))
        .withColumn("fraccion", F.col("ya_en_entrenamiento") / F.col("positivos"))
    )


def require_no_leak(audit: DataFrame, most: float = 0.0) -> None:
    bad = audit.filter(F.col("fraccion") > most).collect()
    if bad:
        raise ValueError(f"validation positives already in training: {[r.asDict() for r in bad]}")


def group_split(panel: DataFrame, seeds: Sequence[int], test_share: float = 0.3) -> DataFrame:
    """Per seed, put whole entities on the test side: (semilla, es_test)."""
    split = panel.withColumn("semilla", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return split.withColumn("es_test", uniform(E, "semilla") < test_share)


def row_split(panel: DataFrame, seed: int, test_share: float = 0.3, classes: str = L) -> DataFrame:
    """Stratified split of rows. One entity can be on both sides: kept as the leaky counter-example."""
    known = panel.filter(F.col(classes).isNotNull()).withColumn("_u", uniform(E, P, seed))
    numbered = row_numbers(known, [classes], [F.col("_u").asc(), F.col(E).asc(), F.col(P).asc()], [F.col("_u"), F.col(E)], "_rn", "_n")
    return numbered.withColumn("es_test", F.col("_rn") <= F.bround(F.col("_n") * test_share)).drop("_u", "_rn", "_n")


def two_stage(panel: DataFrame) -> DataFrame:
    """`se_va`: leaves at all; `en_dos`: leaves in two rather than next, NULL for those who stay."""
    leaves = F.col(L).isin(K.LEAVES_NEXT, K.LEAVES_IN_TWO)
    return panel.filter(F.col(L).isNotNull()).withColumns({
        "se_va": leaves.cast("int"), "en_dos": F.when(leaves, (F.col(L) == K.LEAVES_IN_TWO).cast("int"))
    })


def with_canaries(panel: DataFrame, n_predictors: int, seed: int, ratio: float = 0.2) -> DataFrame:
    """Add noise columns, a fifth as many as there are predictors, reproducible from the keys."""
    n = max(1, int(n_predictors * ratio))
    return panel.withColumns({f"{NOISE}{i:04d}": uniform(E, P, seed + i) for i in range(n)})
