"""Weighted boosted trees and what is done around them: importance, pruning, ablation, ageing.

Every fit is an MLlib job over the whole training set. Independent fits (seeds, folds, sets of
columns) run a few at a time, and a training set they share is materialised once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators import targets as T
from panelmill.operators.forest import forest_of, forest_scores
from panelmill.operators.ranking import auc_from_values, capture_curve, gain_at, ranking
from panelmill.session import checkpoint

E, P, L = K.ENTITY, K.PERIOD, K.LABEL
Y, WEIGHT = T.Y, T.WEIGHT

#: Tree settings of a quick fit. Every function that fits takes `params`; a real recipe passes its own rounds and depth.
DEFAULTS: Mapping[str, object] = {"maxIter": 5, "maxDepth": 3, "maxBins": 32, "stepSize": 0.1, "subsamplingRate": 0.9}


def _together(jobs: Sequence[Callable[[], object]], parallelism: int = 4) -> list:
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def assembled(panel: DataFrame, columns: Sequence[str], keep: Sequence[str] = (E, P, L)) -> DataFrame:
    """Keys and one feature vector; NULL becomes the column's minimum - 1, below every value.

    The minima are one row of one aggregate.
    """
    low = panel.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in columns]).first()
    filled = panel.select(
        *[c for c in keep if c in panel.columns],
        *[F.coalesce(F.col(c).cast("double"), F.lit((low[c] if low[c] is not None else 0.0) - 1.0)).alias(c) for c in columns],
    )
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(filled)
    return vectors.select(*[c for c in keep if c in panel.columns], "features")


def subset(data: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The same rows with some of the vector's features."""
    from pyspark.ml.feature import VectorSlicer

    sliced = VectorSlicer(inputCol="features", outputCol="_f", indices=list(positions)).transform(data)
    return sliced.drop("features").withColumnRenamed("_f", "features")


def fit(train: DataFrame, seed: int, params: Mapping[str, object] = DEFAULTS) -> GBTClassificationModel:
    """Boosted trees on a frame with features, target and weight. Rows of weight 0 are left out."""
    learner = GBTClassifier(featuresCol="features", labelCol=Y, weightCol=WEIGHT, seed=seed, **params)
    return learner.fit(train.filter(F.col(WEIGHT) > 0))


def score(model: GBTClassificationModel, rows: DataFrame, keep: Sequence[str] = (E,)) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(*keep, vector_to_array("probability")[1].alias("score"))


def fit_and_score(train: DataFrame, rows: DataFrame, seeds: Iterable[int], params: Mapping[str, object] = DEFAULTS,
                  keep: Sequence[str] = (E,)) -> DataFrame:
    """One model per seed on the same training set, which all score the rows in one scan: (keep..., modelo, score)."""
    shared = checkpoint(train)
    seeds = list(seeds)
    models = _together([lambda s=s: fit(shared, s, params) for s in seeds])
    return forest_scores(forest_of(dict(zip(seeds, models)), rows.sparkSession), rows, keep)


def with_truth(rows: DataFrame, positive: str = K.LEAVES_IN_TWO) -> DataFrame:
    return rows.withColumn("positivo", F.coalesce(F.col(L) == positive, F.lit(False)).cast("int"))


# --- importance -------------------------------------------------------------------------------

def importances(models: Sequence[GBTClassificationModel], columns: Sequence[str], spark) -> DataFrame:
    """(feature, gain): feature importance added up over models; one row per column."""
    total = [float(sum(m.featureImportances[i] for m in models)) for i in range(len(columns))]
    return spark.createDataFrame(list(zip(columns, total)), "feature string, gain double")


def importance_table(gains: DataFrame) -> DataFrame:
    """Position, percent of the gain and cumulative percent; one row per column of the panel."""
    order = Window.orderBy(F.col("gain").desc(), F.col("feature").asc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pct = F.try_divide(100.0 * F.col("gain"), F.sum("gain").over(whole))
    return gains.withColumns({"pos": F.row_number().over(order), "gain_pct": pct}).withColumn(
        "gain_acum", F.sum("gain_pct").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )


def importance_by_type(table: DataFrame) -> DataFrame:
    """Gain, number of columns and columns in use for raw columns, lags and deltas."""
    kind = F.coalesce(F.nullif(F.regexp_extract("feature", r"__(lag\d|delta\d)$", 1), F.lit("")), F.lit("cruda"))
    return table.groupBy(kind.alias("tipo")).agg(
        F.sum("gain_pct").alias("gain_pct"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("gain") > 0).alias("usadas")
    )


def column_sets(table: DataFrame, share: float = 99.0, top_families: int = 10) -> DataFrame:
    """Per column: never used, in the smallest set that reaches the share, outside the top families."""
    family = F.regexp_replace("feature", "__.*", "")
    families = table.groupBy(family.alias("familia")).agg(F.sum("gain").alias("g"))
    ranked = families.withColumn("lugar", F.row_number().over(Window.orderBy(F.desc("g"), "familia")))
    before = F.col("gain_acum") - F.col("gain_pct")
    return table.withColumn("familia", family).join(ranked.select("familia", "lugar"), "familia").select(
        "feature", "familia", "gain",
        (F.col("gain") == 0).alias("sin_uso"),
        ((F.col("gain") > 0) & (before < share)).alias("en_el_99"),
        (F.col("lugar") > top_families).alias("fuera_de_las_10"),
    )


# --- canaries ---------------------------------------------------------------------------------

def survivors(table: DataFrame, deviations: float | None = 4.0) -> DataFrame:
    """Columns placed before the noise: before median + d * sd of the noise columns' positions.

    With `deviations=None` a column must come before the best noise column. `table` has one row per column.
    """
    noise = F.col("feature").startswith(T.NOISE)
    place = F.when(noise, F.col("pos"))
    limit = F.min(place) if deviations is None else F.median(place) + deviations * F.coalesce(F.stddev(place), F.lit(0.0))
    threshold = table.select(limit.alias("u")).scalar()
    return table.filter(~noise & (F.col("pos") < threshold)).select("feature", "pos", threshold.alias("umbral"))


#: Criteria of a pruning sweep: before the best noise column, or before the noise's median plus so many deviations.
CRITERIA = (None, 0.0, 1.0, 2.0, 4.0)


def noise_importances(panel: DataFrame, columns: Sequence[str], prepared: Callable[[DataFrame], DataFrame], seeds: Sequence[int],
                      ratio: float = 0.2, params: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """(semilla, feature, gain, pos, ...): the importance table of one fit per seed, noise columns included.

    The training rows are stored once; each seed adds its noise columns to them.
    """
    spark = panel.sparkSession
    train = checkpoint(prepared(panel))

    def one(seed: int) -> DataFrame:
        noisy = T.with_canaries(train, len(columns), seed, ratio)
        every = [*columns, *[c for c in noisy.columns if c.startswith(T.NOISE)]]
        model = fit(assembled(noisy, every, (E, P, Y, WEIGHT)), seed, params)
        return importance_table(importances([model], every, spark)).withColumn("semilla", F.lit(seed))

    return reduce(DataFrame.unionByName, _together([lambda s=s: one(s) for s in seeds]))


def _criterion(deviations: float | None) -> str:
    return "mejor" if deviations is None else f"{deviations:g} sd"


def sweep(tables: DataFrame, criteria: Sequence[float | None] = CRITERIA) -> DataFrame:
    """(semilla, criterio, vivas, base, derivadas, sin_uso) of every criterion, from one importance table per seed."""
    noise = F.col("feature").startswith(T.NOISE)
    place = F.when(noise, F.col("pos"))
    limits = tables.groupBy(F.col("semilla").alias("_s")).agg(
        F.min(place).alias("_best"), F.median(place).alias("_mid"), F.coalesce(F.stddev(place), F.lit(0.0)).alias("_sd")
    )
    threshold = lambda d: F.col("_best").cast("double") if d is None else F.col("_mid") + d * F.col("_sd")
    marks = F.explode(F.array(*[F.struct(F.lit(_criterion(d)).alias("c"), threshold(d).alias("u")) for d in criteria]))
    placed = tables.filter(~noise).join(limits, F.col("semilla") == F.col("_s")).withColumn("_m", marks)
    alive, derived = F.col("pos") < F.col("_m.u"), F.col("feature").contains("__")
    return placed.groupBy("semilla", F.col("_m.c").alias("criterio")).agg(
        F.count_if(alive).alias("vivas"), F.count_if(alive & ~derived).alias("base"), F.count_if(alive & derived).alias("derivadas"),
        F.count_if(F.col("gain") == 0).alias("sin_uso"), F.first("_m.u").alias("umbral"),
    )


def votes_of(tables: DataFrame, seeds: int, deviations: float | None = 4.0) -> DataFrame:
    """(feature, votos, sobrevive) by the seeds in which a column comes before the noise; a majority keeps it."""
    own = tables.select("semilla").distinct().collect()  # one row per fit
    alive = reduce(DataFrame.unionByName, [survivors(tables.filter(F.col("semilla") == r[0]), deviations).select("feature") for r in own])
    votes = alive.groupBy("feature").agg(F.count(F.lit(1)).alias("votos"))
    return votes.withColumn("sobrevive", F.col("votos") >= seeds // 2 + 1)


def prune(panel: DataFrame, columns: Sequence[str], prepared: Callable[[DataFrame], DataFrame], seeds: Sequence[int],
          ratio: float = 0.2, deviations: float | None = 4.0, params: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Votes per column over seeds. Which noise column does well differs by seed, so several fits decide."""
    return votes_of(noise_importances(panel, columns, prepared, seeds, ratio, params), len(seeds), deviations)


# --- designs ----------------------------------------------------------------------------------

def evaluate(data: DataFrame, folds: Sequence[T.Fold], seeds: Sequence[int], kind: str = "pesos", weight_next: float = 0.25,
             params: Mapping[str, object] = DEFAULTS, positions: Sequence[int] | None = None) -> DataFrame:
    """Scores of every (fold, seed): (entity, fold, semilla, positivo, score). `data` is assembled."""
    data = data if positions is None else subset(data, positions)
    data = checkpoint(data)
    jobs, frames = [], []
    for fold in folds:
        fold.checked(1)
        train = T.prepare(data, fold.train, kind, weight_next)
        for seed in seeds:
            jobs.append(lambda t=train, s=seed: fit(t, s, params))
    models = iter(_together(jobs))
    for fold in folds:
        rows = with_truth(data.filter(F.col(P) == fold.validation), fold.positive)
        for seed in seeds:
            scored = score(next(models), rows, (E, "positivo"))
            frames.append(scored.withColumns({"fold": F.lit(fold.name), "semilla": F.lit(seed)}))
    return reduce(DataFrame.unionByName, frames)


def gains_by_seed(scored: DataFrame, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """Gain at the cut for every (fold, seed): the observations of a paired comparison. NULL below k rows."""
    group = [*extra, "fold", "semilla"]
    return gain_at(ranking(scored, group), k, group).drop("envios")


def ablation(data: DataFrame, columns: Sequence[str], sets: Mapping[str, Sequence[str]], folds: Sequence[T.Fold],
             seeds: Sequence[int], k: int, params: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """(config, fold, semilla, ganancia) for each set of columns, on the same folds and seeds."""
    place = {c: i for i, c in enumerate(columns)}
    data = checkpoint(data)
    parts = [
        evaluate(data, folds, seeds, params=params, positions=[place[c] for c in chosen]).withColumn("config", F.lit(name))
        for name, chosen in sets.items()
    ]
    return gains_by_seed(reduce(DataFrame.unionByName, parts), k, ["config"])


def search(data: DataFrame, candidates: Mapping[str, Mapping[str, object]], folds: Sequence[T.Fold], seeds: Sequence[int],
           params: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """AUC of each candidate by fold and seed, out of time: (config, fold, semilla, auc). Candidates change `params`."""
    data = checkpoint(data)
    parts = [
        evaluate(data, folds, seeds, params={**params, **p}).withColumn("config", F.lit(name))
        for name, p in candidates.items()
    ]
    scored = reduce(DataFrame.unionByName, parts)
    return auc_from_values(scored, ["config", "fold", "semilla"], "score", F.col("positivo"))


def revalidated(aucs: DataFrame, searched: Sequence[str], unseen: str) -> DataFrame:
    """Mean AUC on the searched folds and on an unseen one, both ranks of each candidate, and their rank correlation.

    Folds are averaged by name; one row per candidate.
    """
    means = aucs.groupBy("config").agg(
        F.avg(F.when(F.col("fold").isin(*searched), F.col("auc"))).alias("auc_busqueda"),
        F.avg(F.when(F.col("fold") == unseen, F.col("auc"))).alias("auc_futuro"),
    )
    ranked = means.withColumns({
        "puesto_busqueda": F.rank().over(Window.orderBy(F.desc("auc_busqueda"))),
        "puesto_futuro": F.rank().over(Window.orderBy(F.desc("auc_futuro"))),
    })
    every = Window.partitionBy()
    average = {c: F.col(c) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2 for c in ("puesto_busqueda", "puesto_futuro")}
    return ranked.withColumns({f"_{c}": e for c, e in average.items()}).withColumn(
        "rho", F.corr("_puesto_busqueda", "_puesto_futuro").over(every)
    ).drop("_puesto_busqueda", "_puesto_futuro")


def ageing(data: DataFrame, train: int, validations: Sequence[int], seeds: Sequence[int], start: int, stop: int, step: int,
           params: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Capture of models of one month at several distances, mean over seeds: (distancia, K, captura)."""
    folds = [T.Fold(str(v), (train,), v) for v in validations]
    curves = capture_curve(ranking(evaluate(data, folds, seeds, params=params), ["fold", "semilla"]), start, stop, step, ["fold", "semilla"])
    distance = F.create_map(*[x for f in folds for x in (F.lit(f.name), F.lit(f.gap()))])
    return curves.groupBy(distance[F.col("fold")].alias("distancia"), "K").agg(F.avg("captura").alias("captura"))


def month_quality(data: DataFrame, sets: Mapping[str, tuple[int, ...]], validation: int, seeds: Sequence[int], k: int,
                  params: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """Gain and capture at a cut by set of training months: (meses, distancia, ganancia, captura), NULL below k rows."""
    folds = [T.Fold(name, months, validation) for name, months in sets.items()]
    ranked = ranking(evaluate(data, folds, seeds, params=params), ["fold", "semilla"])
    here = {c: F.max(F.when(F.col("puesto") == k, F.col(c))).alias(c) for c in ("ganancia", "aciertos", "positivos")}
    at = ranked.groupBy("fold", "semilla").agg(*here.values())
    distance = F.create_map(*[x for f in folds for x in (F.lit(f.name), F.lit(f.gap()))])
    return at.groupBy(F.col("fold").alias("meses"), distance[F.col("fold")].alias("distancia")).agg(
        F.avg("ganancia").alias("ganancia"), F.avg(F.col("aciertos") / F.col("positivos")).alias("captura")
    )


def per_month_scores(data: DataFrame, months: Sequence[int], rows: DataFrame, seed: int,
                     params: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """One model per training month: (entity, modelo = month, score)."""
    data = checkpoint(data)
    models = _together([lambda m=m: fit(T.prepare(data, [m], "pesos", 0.25), seed, params) for m in months])
    return reduce(
        DataFrame.unionByName, [score(m, rows).withColumn("modelo", F.lit(p)) for m, p in zip(models, months)]
    )


def two_stage_scores(data: DataFrame, train: Sequence[int], rows: DataFrame, seed: int,
                     params: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """P(leaves) * P(in two | leaves), the second model fitted on leavers only."""
    staged = checkpoint(T.two_stage(data.filter(F.col(P).isin(*train))).withColumn(WEIGHT, F.lit(1.0)))
    first, second = _together([
        lambda: fit(staged.withColumnRenamed("se_va", Y), seed, params),
        lambda: fit(staged.filter("se_va = 1").withColumnRenamed("en_dos", Y), seed, params),
    ])
    a = score(first, rows).withColumnRenamed("score", "p_se_va")
    b = score(second, rows).withColumnRenamed("score", "p_en_dos")
    return a.join(b, E).withColumn("score", F.col("p_se_va") * F.col("p_en_dos"))


def adversarial(panel: DataFrame, columns: Sequence[str], train: Sequence[int], target: int, seed: int,
                params: Mapping[str, object] = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Can a model tell the target month from the training months? Returns (auc table, importance table).

    Whole entities are held out, so the model cannot recognise a customer.
    """
    rows = panel.filter(F.col(P).isin(*train, target))
    split = T.group_split(rows, [seed]).withColumns({
        Y: (F.col(P) == target).cast("int"), WEIGHT: F.lit(1.0)
    })
    data = checkpoint(assembled(split, columns, (E, P, Y, WEIGHT, "es_test")))
    model = fit(data.filter(~F.col("es_test")), seed, params)
    scored = score(model, data.filter("es_test"), (Y,))
    auc = auc_from_values(scored.withColumn("prueba", F.lit("mes objetivo")), ["prueba"], "score", F.col(Y))
    return auc, importance_table(importances([model], columns, panel.sparkSession))


def variants(panel: DataFrame, configs: Mapping[str, Mapping[str, object]], cuts: Sequence[int]) -> DataFrame:
    """(config, modelo, envios, ganancia) of every configuration, seed and cut; NULL where a ranking is shorter."""
    scored = [variant(panel, c).withColumn("config", F.lit(name)) for name, c in configs.items()]
    ranked = ranking(reduce(DataFrame.unionByName, scored), ["config", "modelo"])
    at = [F.struct(F.lit(k).cast("long").alias("envios"), F.max(F.when(F.col("puesto") == k, F.col("ganancia"))).alias("ganancia")) for k in cuts]
    return ranked.groupBy("config", "modelo").agg(F.array(*at).alias("_at")).select("config", "modelo", F.inline("_at"))


def variant(panel: DataFrame, config: Mapping[str, object]) -> DataFrame:
    """One configuration as one job: columns, target, months, seeds, settings -> scores of a month."""
    data = checkpoint(assembled(panel, config["columnas"]))
    train = T.prepare(data, config["meses"], config["target"], config.get("peso_baja1", 0.0))
    rows = with_truth(data.filter(F.col(P) == config["mes"]))
    return fit_and_score(train, rows, config["semillas"], {**DEFAULTS, **config.get("params", {})}, (E, "positivo"))
