"""Queries that fit models. Their results depend on the learner: `q_model_facts` checks what does not."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators import history as H
from panelmill.operators import models as M
from panelmill.operators import ranking as R
from panelmill.operators import targets as T
from panelmill.plans.base import E, L, P, labelled
from panelmill.plans.registry import query
from panelmill.session import checkpoint

COLUMNS = ["ctrx_quarter", "mcuentas_saldo", "cproductos", "mcomisiones", "mpayroll", "cpayroll_trx", "Visa_status"]
WITH_HISTORY = COLUMNS + [f"{c}__{s}" for c in COLUMNS for s in ("lag1", "delta1")]
SEEDS = K.SEEDS[:2]
FOLDS = (T.Fold("A", (202103,), 202105), T.Fold("B", (202103, 202104), 202106))


def _with_history(panel):
    return checkpoint(H.add(panel, H.lags(COLUMNS), H.deltas(COLUMNS)))


def _panel(spark, folder):
    return _with_history(labelled(spark, folder, COLUMNS))


def _data(spark, folder, columns=WITH_HISTORY):
    return checkpoint(M.assembled(_panel(spark, folder), columns))


def _train(data):
    return T.prepare(data, (202103, 202104), "pesos", 0.25)


@query("model_scores_by_seed", "ML1 ML2")
def model_scores_by_seed(spark, folder):
    data = _data(spark, folder)
    return M.fit_and_score(_train(data), data.filter(F.col(P) == 202106), SEEDS)


@query("model_rank_ensemble", "ML2 EN1 ML16")
def model_rank_ensemble(spark, folder):
    config = {"columnas": COLUMNS, "target": "pesos", "peso_baja1": 0.25, "meses": (202103, 202104), "mes": 202106,
              "semillas": SEEDS, "params": {"maxIter": 4}}
    return R.rank_ensemble(M.variant(_panel(spark, folder), config), keep=["positivo"])


@query("one_model_per_month", "ML3")
def one_model_per_month(spark, folder):
    data = _data(spark, folder, COLUMNS)
    scored = M.per_month_scores(data, (202103, 202104), data.filter(F.col(P) == 202106), SEEDS[0])
    return R.rank_ensemble(scored)


@query("two_stage_scores", "ML4 TG10")
def two_stage_scores(spark, folder):
    data = _data(spark, folder, COLUMNS)
    return M.two_stage_scores(data, (202103, 202104), data.filter(F.col(P) == 202106), SEEDS[0])


def _importance(spark, folder):
    train = checkpoint(_train(_data(spark, folder)))
    return M.importance_table(M.importances([M.fit(train, s) for s in SEEDS], WITH_HISTORY, spark))


@query("feature_importance", "ML5")
def feature_importance(spark, folder):
    return _importance(spark, folder)


@query("importance_by_type", "ML6")
def importance_by_type(spark, folder):
    return M.importance_by_type(_importance(spark, folder))


@query("importance_column_sets", "ML19")
def importance_column_sets(spark, folder):
    return M.column_sets(_importance(spark, folder), 99.0, 3)


@query("canary_pruning", "ML7 TG11 AG14")
def canary_pruning(spark, folder):
    return M.prune(_panel(spark, folder), WITH_HISTORY, _train, K.SEEDS)


@query("feature_set_ablation", "ML8 SR6")
def feature_set_ablation(spark, folder):
    sets = {"base": COLUMNS, "con_historia": WITH_HISTORY}
    return M.ablation(_data(spark, folder), WITH_HISTORY, sets, FOLDS, SEEDS, k=300)


@query("pruning_sweep", "ML7 TG11")
def pruning_sweep(spark, folder):
    """Columns alive under each criterion, from one fit per seed."""
    return M.sweep(checkpoint(M.noise_importances(_panel(spark, folder), WITH_HISTORY, _train, K.SEEDS[:2])))


@query("adversarial_auc", "ML13 TG8")
def adversarial_auc(spark, folder):
    return M.adversarial(_panel(spark, folder), COLUMNS, (202103, 202104), 202109, SEEDS[0])[0]


@query("adversarial_importance", "ML13 ML5")
def adversarial_importance(spark, folder):
    return M.adversarial(_panel(spark, folder), COLUMNS, (202103, 202104), 202109, SEEDS[0])[1]


@query("out_of_time_search", "ML15 ML14")
def out_of_time_search(spark, folder):
    candidates = {"receta": {}, "mas_hondo": {"maxDepth": 4}, "mas_lento": {"stepSize": 0.05}}
    folds = (*FOLDS, T.Fold("futuro", (202103, 202104, 202105), 202107))
    aucs = M.search(_data(spark, folder, COLUMNS), candidates, folds, SEEDS[:1])
    return M.revalidated(aucs, ("A", "B"), "futuro")


@query("prediction_distance_ageing", "ML17 DC5")
def prediction_distance_ageing(spark, folder):
    return M.ageing(_data(spark, folder, COLUMNS), 202103, (202105, 202106), SEEDS, 100, 500, 100)


@query("training_month_quality", "ML18")
def training_month_quality(spark, folder):
    sets = {"marzo": (202103,), "abril": (202104,), "marzo_abril": (202103, 202104)}
    return M.month_quality(_data(spark, folder, COLUMNS), sets, 202106, SEEDS[:1], 300)


@query("model_prevalence", "DC9 ML2")
def model_prevalence(spark, folder):
    """Expected leavers of an unlabelled month: the sum of probabilities per seed."""
    data = _data(spark, folder, COLUMNS)
    train = T.prepare(data, (202103, 202104), "baja2")
    months = data.filter(F.col(P).isin(202106, 202108))
    scored = M.fit_and_score(train, M.with_truth(months), SEEDS, keep=(E, P, "positivo"))
    sums = scored.groupBy(P, "modelo").agg(F.sum("score").alias("suma_p"), F.sum("positivo").alias("real"))
    return sums.groupBy(P).agg(
        F.avg("suma_p").alias("suma_p_media"), F.stddev_pop("suma_p").alias("suma_p_sd"), F.max("real").alias("real")
    )
