"""Decisions over every place of a ranking, against running sums in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.draws import uniform
from panelmill.operators import curves as C
from panelmill.operators import ranking as R

E = K.ENTITY


def _month(seed, n, rate_of):
    """Scores that fall with the entity, hits at the rate of their place."""
    rng = np.random.default_rng(seed)
    place = np.arange(n)
    return pd.DataFrame({E: place, "score": 1 - np.round(place / n, 2), "positivo": (rng.random(n) < rate_of(place / n)).astype(int)})


def _gains(frame):
    ordered = frame.sort_values(["score", E], ascending=[False, True])
    return np.where(ordered.positivo == 1, K.GAIN_HIT, -K.COST_MISS).cumsum()


@pytest.fixture(scope="module")
def months():
    """The optimum of model 1 lies far past place 600, that of 2 at the first places, of 3 at the very end; 4 never gains."""
    rates = {1: lambda x: np.where(x < 0.55, 0.08, 0.0), 2: lambda x: np.where(x < 0.01, 0.5, 0.0), 3: lambda x: 0.2 + 0 * x, 4: lambda x: 0 * x}
    return {m: _month(m, 3_000 - 400 * m, rate) for m, rate in rates.items()}


@pytest.fixture(scope="module")
def scored(spark, months):
    return spark.createDataFrame(pd.concat([f.assign(modelo=m) for m, f in months.items()])).cache()


def test_best_cut_of_all_places(spark, months, scored, many_blocks):
    got = {r.modelo: (r.envios, r.ganancia, r.n) for r in C.best_cuts(scored, ["modelo"]).collect()}
    want = {}
    for m, f in months.items():
        g = _gains(f)
        want[m] = (int(g.argmax()) + 1, int(g.max()), len(f))
    assert got == want
    assert want[1][0] > 600 and want[2][0] < 100 and want[4] == (1, -K.COST_MISS, 1_400)


def test_best_cut_of_null_groups_and_of_nothing(scored):
    one = scored.filter("modelo = 1").withColumn("modelo", F.lit(None).cast("int"))
    row = C.best_cuts(one, ["modelo"]).first()
    assert row.modelo is None and row.envios == C.best_cuts(scored.filter("modelo = 1")).first().envios
    assert C.best_cuts(scored.filter("false"), ["modelo"]).count() == C.best_cuts(scored.filter("false")).count() == 0


def test_mean_curves_stop_where_the_shortest_ranking_does(scored, months):
    means = C.mean_curve(R.ranking(scored, ["modelo"]), F.col("ganancia"), ["modelo"], "ganancia")
    got = {r.K: r.ganancia for r in means.collect()}
    shortest = min(map(len, months.values()))
    want = np.mean([_gains(f)[:shortest] for f in months.values()], axis=0)
    assert sorted(got) == list(range(1, shortest + 1))
    np.testing.assert_allclose([got[k + 1] for k in range(shortest)], want)
    row = C.plateau(means, tolerance=0.9, low=0.1, high=0.5).first()
    inside = np.flatnonzero(want >= want.max() * 0.9) + 1
    assert (row.mejor, row.desde, row.hasta) == (want.argmax() + 1, inside.min(), inside.max())
    assert row.centro == max(min((inside.min() + inside.max()) // 2, shortest // 2), shortest // 10)


def test_scenarios_over_all_places(scored, months):
    ranked = R.ranking(scored.filter("modelo < 3"), ["modelo"])
    prevalences = (20, 90, 300)
    captures = C.mean_curve(ranked, F.col("aciertos") / F.col("positivos"), ["modelo"], "captura")
    losses = C.scenario_losses(captures, prevalences)
    curves = {r.K: r.captura for r in captures.collect()}
    k = np.array(sorted(curves))
    c = np.array([curves[i] for i in k])
    gains = np.array([c * p * K.GAIN_HIT - (k - c * p) * K.COST_MISS for p in prevalences])
    lost = 100 * (gains.max(axis=1, keepdims=True) - gains) / gains.max(axis=1, keepdims=True)
    row = C.minimax(losses, "K", losses_positive=True).first()
    assert row.corte_minimax == k[lost.max(axis=0).argmin()] and row.peor_en_minimax == pytest.approx(lost.max(axis=0).min())
    assert row.corte_esperado == k[lost.mean(axis=0).argmin()]
    assert losses.filter("array_min(perdidas) = 0").count() >= 1


def test_display_marks_equal_shares_and_the_end(scored):
    ranked = R.ranking(scored, ["modelo"])
    shown = C.display(ranked, 40).groupBy("modelo").agg(F.count(F.lit(1)).alias("rows"), F.max("puesto").alias("last"), F.max("n").alias("n"))
    assert all(r.rows == 40 and r["last"] == r.n for r in shown.collect())
    assert C.display(ranked.filter("puesto <= 3").withColumn("n", F.lit(3)), 40).filter("modelo = 1").count() == 3


def test_losses_against_the_best_place(scored, months):
    lost = C.curve_losses(R.ranking(scored, ["modelo"]), ["modelo"]).filter("modelo = 1").orderBy("puesto").collect()
    g = _gains(months[1])
    np.testing.assert_allclose([r.regret for r in lost], g / g.max() - 1)


def test_draws_peak_where_their_running_sums_do(spark, months, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 100)
    frame = months[1]
    ranked = R.ranking(spark.createDataFrame(frame))
    got = {r.rep: (r.k_publico, r.privado_en_argmax, r.k_real) for r in C.draw_optima(ranked, 8).collect()}
    drawn = ranked.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("u", uniform(E, "rep")).orderBy("rep", "puesto").toPandas()
    for rep, own in drawn.groupby("rep"):
        g = np.where(own.positivo == 1, K.GAIN_HIT, -K.COST_MISS)
        public = np.where(own.u < 0.25, g, 0).cumsum()
        rest = g.cumsum() - public
        k = public.argmax()
        assert got[rep] == (k + 1, rest[k], g.cumsum().argmax() + 1)
    assert max(v[0] for v in got.values()) > 600


def test_a_number_is_drawn_once_for_all_sums(spark, months):
    """The sums named it six times, so its digest was computed four to six times for every row and draw."""
    sums = C.draw_sums(R.ranking(spark.createDataFrame(months[1])), 8)
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
