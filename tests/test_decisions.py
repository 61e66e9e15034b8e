"""Rankings, cuts, ensembles, resampling, targets and drift: properties and hand values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions.draws import poisson_one, uniform
from panelmill.operators import drift as D
from panelmill.operators import ranking as R
from panelmill.operators import resampling as S
from panelmill.operators import targets as T

E, P, L = K.ENTITY, K.PERIOD, K.LABEL


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    n = 900
    y = (rng.random(n) < 0.2).astype(int)
    frames = [
        pd.DataFrame({E: np.arange(n), "modelo": m, "score": np.round(rng.random(n) + 0.4 * y, 1), "positivo": y, "flag": rng.integers(0, 2, n)})
        for m in (1, 2, 3)
    ]
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def table(spark, scored):
    return spark.createDataFrame(scored).cache()


def _curve(scored, m):
    part = scored[scored.modelo == m].sort_values(["score", E], ascending=[False, True])
    return part, np.where(part.positivo == 1, K.GAIN_HIT, -K.COST_MISS).cumsum()


def test_break_even():
    assert K.BREAK_EVEN == 0.025


@pytest.mark.usefixtures("many_blocks")
def test_ranking_is_the_stable_sort(table, scored):
    got = R.ranking(table, ["modelo"]).toPandas()
    for m in (1, 2, 3):
        part, curve = _curve(scored, m)
        mine = got[got.modelo == m].sort_values("puesto")
        assert mine[E].tolist() == part[E].tolist()
        assert mine.ganancia.tolist() == curve.tolist()
        assert mine.ganancia.iloc[-1] == mine.ganancia_todos.iloc[0]


def test_top_k_lists_are_nested(table):
    one = table.filter("modelo = 1")
    small, large = ({r[E] for r in R.top_k(one, k).collect()} for k in (100, 250))
    assert len(small) == 100 and small < large
    again = {r[E] for r in R.top_k(table, 100, ["modelo"]).filter("modelo = 1").collect()}
    assert again == small


def test_ensemble_is_the_mean_of_pandas_ranks(table, scored):
    got = R.rank_ensemble(table).toPandas().set_index(E)["score"].sort_index()
    wide = scored.pivot(index=E, columns="modelo", values="score")
    np.testing.assert_allclose(got, wide.rank(pct=True).mean(axis=1), atol=1e-12)


def test_regret_is_zero_at_the_best_point(table):
    ranked = R.ranking(table, ["modelo"])
    loss = R.regret_on_curve(ranked, ["modelo"], 1, 900, 1)
    best = loss.groupBy("modelo").agg(F.max("regret").alias("r")).collect()
    assert all(r.r == 0.0 for r in best)


def test_plateau_and_best_cut(spark):
    curves = spark.createDataFrame([(1000, 10.0), (1250, 100.0), (1500, 99.9), (1750, 99.7), (2000, 50.0)], "envios long, ganancia double")
    row = R.plateau(curves, lowest=0, highest=10_000).first()
    assert (row.desde, row.centro, row.hasta) == (1250, 1500, 1750)
    assert R.plateau(curves).first().centro == K.MIN_SELECTED
    assert R.best_cut(curves).first().envios == 1250


def test_parabola_vertex(spark):
    x = [9_000, 10_000, 11_000, 12_500, 14_000]
    points = spark.createDataFrame([(k, 100 - ((k - 11_700) / 1000.0) ** 2, 0.5 + i / 10) for i, k in enumerate(x)], "k long, y double, e double")
    row = R.quadratic_vertex(points, "k", "y", "e").first()
    assert row.vertice == pytest.approx(11_700, abs=1e-4) and row.es_maximo


def test_scores_must_be_binary(table):
    R.require_binary(table, "positivo")
    with pytest.raises(TypeError):
        R.require_binary(table.withColumn("positivo", F.lit("BAJA+2")), "positivo")
    with pytest.raises(TypeError):
        R.require_binary(table.withColumn("positivo", F.lit(2)), "positivo")


def test_guard_fails_closed(table):
    one = table.filter("modelo = 1")
    good = one.filter("flag = 1").limit(50)
    report = R.selection_guard(good, one, {"marca": "flag = 1"}, 1.5)
    R.require_valid_selection(report)
    strangers = good.withColumn(E, F.col(E) + 100_000)
    for bad in (strangers, one.filter("flag = 0").limit(50)):
        with pytest.raises(ValueError):
            R.require_valid_selection(R.selection_guard(bad, one, {"marca": "flag = 1"}, 1.5))
    with pytest.raises(ValueError):
        R.require_valid_selection(R.selection_guard(good, one, {"nunca": "flag = 9"}, 1.5))


def test_alignment_is_required(table):
    a = table.filter("modelo = 1")
    R.require_aligned(a, table.filter("modelo = 2"))
    with pytest.raises(ValueError, match="different entities"):
        R.require_aligned(a, a.filter(F.col(E) > 5))


def test_auc_matches_pairs(table, scored):
    got = R.score_auc(table).toPandas().set_index("modelo")["auc"]
    for m, part in scored.groupby("modelo"):
        p, q = part.score[part.positivo == 1].to_numpy(), part.score[part.positivo == 0].to_numpy()
        want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
        assert got[m] == pytest.approx(want, abs=1e-12)


def test_draws_are_fair_and_bootstrap_is_centred(spark, table):
    u = spark.range(20_000).select(uniform("id", 5).alias("u")).select(F.avg("u").alias("m"), F.avg(poisson_one(F.col("u"))).alias("w"), F.var_pop(poisson_one(F.col("u"))).alias("v")).first()
    assert abs(u.m - 0.5) < 0.01 and abs(u.w - 1) < 0.03 and abs(u.v - 1) < 0.06
    a, b = (R.top_k(table.filter(f"modelo = {m}"), 200) for m in (1, 2))
    truth = sum(s * d.select(F.sum(R.contribution(F.col("positivo") == 1))).first()[0] for s, d in ((1, a), (-1, b)))
    stats = S.interval(S.bootstrap_difference(a, b, 400)).first()
    assert abs(stats.media - truth) < 4 * stats.sd / np.sqrt(400) + 1 and stats.desde < truth < stats.hasta


def test_exact_draws_have_exact_size(table):
    ranked = R.ranking(table.filter("modelo = 1")).select(E, "positivo", "puesto")
    rows = S.exact_public_draws(ranked, 5, 100).collect()
    assert len(rows) == 5 and all(r.sorteados == 225 for r in rows)


@pytest.mark.parametrize("d,p", [([1, 2, 3, 4, 5], 0.0625), ([1, -2, 3, 4, 5], 0.1875), ([0, 0], 1.0), ([3, 0, -1, 2], 0.5), ([*range(1, 61)], 2 / 2**60)])
def test_signed_rank_p(spark, d, p):
    rows = [(c, i, 0, float(v)) for c, vs in (("base", [0] * len(d)), ("x", d)) for i, v in enumerate(vs)]
    obs = spark.createDataFrame(rows, "config string, fold int, semilla int, ganancia double")
    exact, normal = (S.paired_p_values(obs, "base", m).first() for m in ("exact", "normal"))
    assert (exact.metodo, normal.metodo) == ("exact", "normal") and exact.p == pytest.approx(p, rel=1e-9)
    n = sum(v != 0 for v in d)
    ranks = pd.Series([abs(v) for v in d if v]).rank()
    w = min(sum(r for r, v in zip(ranks, [v for v in d if v]) if v > 0), sum(r for r, v in zip(ranks, [v for v in d if v]) if v < 0))
    want = 1.0 if not n else math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * n * (n + 1) * (2 * n + 1) / 24))
    assert normal.p == pytest.approx(want, abs=1e-12)


def test_paired_comparison(spark):
    rows = [("base", f, s, 10.0) for f in ("A", "B") for s in (1, 2, 3)] + [
        ("x", f, s, 10.0 + i) for i, (f, s) in enumerate((f, s) for f in ("A", "B") for s in (1, 2, 3))
    ]
    obs = spark.createDataFrame(rows, "config string, fold string, semilla int, ganancia double")
    r = S.paired_comparison(obs, "base").first()
    assert (r.dif_media, r.gana, r.pares, r.n, r.w) == (2.5, 5, 6, 5, 0.0)
    assert S.paired_p_values(obs, "base").first().p == pytest.approx(0.0625)


def test_fold_gap_is_enforced(spark):
    with pytest.raises(ValueError, match="already be positives"):
        T.Fold("x", (202103,), 202104).checked()
    assert T.Fold("y", (202011, 202012), 202102).checked().gap() == 2


def test_adjacent_months_leak_and_the_audit_fails_the_job(spark):
    panel = spark.createDataFrame(
        [(1, 202103, "BAJA+2"), (1, 202104, "BAJA+1"), (2, 202104, "BAJA+1"), (3, 202105, "BAJA+1")], f"{E} long, {P} int, {L} string"
    )
    audit = T.leak_audit(panel, [((202103,), 202104), ((202103,), 202105)])
    assert {r.validacion: r.fraccion for r in audit.collect()} == {202104: 0.5, 202105: 0.0}
    with pytest.raises(ValueError, match="already in training"):
        T.require_no_leak(audit)


def test_entity_split_keeps_entities_whole(spark):
    panel = spark.range(400).select((F.col("id") % 100).alias(E), (F.col("id") % 4 + 202101).cast("int").alias(P))
    sides = T.group_split(panel, [7]).groupBy(E).agg(F.count_distinct("es_test").alias("n"))
    assert sides.filter("n > 1").count() == 0


def test_psi_and_auc_against_numpy(spark, many_blocks):
    rng = np.random.default_rng(2)
    ref, act = rng.normal(size=500).round(2), (rng.normal(size=700) * 1.2).round(2)
    rows = [(i, 202103, float(v), "BAJA+2" if i % 7 == 0 else "CONTINUA") for i, v in enumerate(ref)]
    rows += [(i, 202106, float(v), "BAJA+2" if i % 5 == 0 else "CONTINUA") for i, v in enumerate(act)]
    rows += [(9000 + i, p, None, "CONTINUA") for i in range(40) for p in (202103, 202106)]
    panel = spark.createDataFrame(rows, f"{E} long, {P} int, x double, {L} string").withColumn("constante", F.lit(1.0))
    q = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    a, e = (np.histogram(v, bins=q)[0] for v in (act, ref))
    a, e = a / a.sum() + 1e-10, e / e.sum() + 1e-10
    got = {r.feature: r.psi for r in D.psi(panel, ["x", "constante"], 202103, 202106).collect()}
    assert got["x"] == pytest.approx(((a - e) * np.log(a / e)).sum(), abs=1e-9) and got["constante"] is None
    low = {r[P]: r.auc for r in D.univariate_auc(panel, ["x"], nulls="bottom").collect()}
    top = {r[P]: r.auc for r in D.univariate_auc(panel, ["x"], nulls="top").collect()}
    assert all(low[p] > top[p] for p in low)  # the NULL rows are all negatives


def test_psi_reads_the_panel_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, p, float(i % 17 + (p == 202106) * (i % 3))) for i in range(300) for p in (202103, 202104, 202106)]
    panel = spark.createDataFrame(rows, f"{E} long, {P} int, x double")
    want = D.psi(panel, ["x"], 202103, 202106).first().psi
    once = D.psi(panel.mapInArrow(counted, panel.schema), ["x"], 202103, 202106)
    assert once.first().psi == pytest.approx(want, abs=1e-12) and want > 0 and read.value == 900


def test_comoments_of_many_tasks_are_those_of_all_rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=4_000) * 1e3 + 1e6
    frame = pd.DataFrame({"a": x, "b": 2 * x + rng.normal(size=4_000), "c": rng.normal(size=4_000), "d": 7.3})
    panel = spark.createDataFrame(frame).withColumn("c", F.when(F.col("c") < 1, F.col("c"))).repartition(9)
    told = D.comoments(panel.fillna(0.0)).collect()
    want = frame.assign(c=frame.c.where(frame.c < 1, 0.0))
    assert len(told) == 1 and told[0].n == 4_000
    np.testing.assert_allclose(np.array(told[0].moments).reshape(4, 4) / 3_999, want.cov(), rtol=1e-8, atol=1e-8)
    pairs = [tuple(r) for r in D.correlated_pairs(panel, ["a", "b", "c", "d"], 0.0).collect()]
    assert [p[:2] for p in pairs] == [("a", "b"), ("a", "c"), ("b", "c")]  # the constant has none
    np.testing.assert_allclose([p[2] for p in pairs], [want.corr().loc[p[0], p[1]] for p in pairs], atol=1e-9)
    with pytest.raises(ValueError, match="two rows"):
        D.correlated_pairs(panel.limit(1), ["a", "b"])
