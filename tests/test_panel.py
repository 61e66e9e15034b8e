"""Labels, lifetime columns, history features and repairs on small panels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.functions import scalars as S
from panelmill.functions import selectors as C
from panelmill.functions.period import add_periods, index_period, period_index, periods_between
from panelmill.operators import history as H
from panelmill.operators import label as A
from panelmill.operators import repair as Q
from panelmill.plans import datasets as D

E, P, L = K.ENTITY, K.PERIOD, K.LABEL
ROWS = [
    (1, 202103, 10.0, 1), (1, 202104, None, 2), (1, 202106, 30.0, 4), (2, 202103, 0.0, 1),
    (3, 202103, None, 7), (3, 202104, 5.0, 7), (3, 202105, 7.0, 7),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, f"{E} long, {P} int, x double, t int").cache()


def _by_key(df):
    return {(r[E], r[P]): r for r in df.collect()}


def test_label_of_the_hand_panel(small):
    rows = _by_key(A.churn_label(small))
    assert {k: r[L] for k, r in rows.items()} == {
        (1, 202103): "BAJA+2", (1, 202104): "BAJA+1", (1, 202106): None, (2, 202103): "BAJA+1",
        (3, 202103): "CONTINUA", (3, 202104): "BAJA+2", (3, 202105): "BAJA+1",
    }


def test_label_equals_leads_over_the_grid(spark):
    rng = np.random.default_rng(5)
    rows = [(int(e), 202011 + m if m < 2 else 202099 + m) for e in range(300) for m in range(9) if rng.random() < 0.6]
    panel = spark.createDataFrame(rows, f"{E} long, {P} int")
    fast = A.churn_label(panel).select(E, P, L)
    assert A.differences(fast, A.label_from_grid(panel)).count() == 0


def test_presence_grid_is_complete(small):
    grid = A.presence_grid(small).toPandas()
    assert len(grid) == 3 * 4 and grid["presente"].sum() == len(ROWS)


def test_lifetime(small):
    rows = _by_key(A.build_base(small))
    assert rows[1, 202103].k == 3 and not rows[1, 202103].es_baja and rows[1, 202103].mes_baja is None
    assert rows[3, 202103].es_baja and rows[3, 202103].mes_baja == 202106 and rows[3, 202103].meses_historia == 3
    last = [k for k, r in rows.items() if r.k == 0]
    assert sorted(e for e, _ in last) == [1, 2, 3]


def test_every_leaver_is_both_classes_in_turn(spark):
    """A leave in two periods is a leave in one, one period later."""
    rng = np.random.default_rng(6)
    panel = spark.createDataFrame([(e, 202101 + m) for e in range(200) for m in range(6) if rng.random() < 0.8], f"{E} long, {P} int")
    lab = A.churn_label(panel).toPandas()
    two = {(r[E], r[P] + 1) for _, r in lab[lab[L] == "BAJA+2"].iterrows()}
    one = {(r[E], r[P]) for _, r in lab[lab[L] == "BAJA+1"].iterrows()}
    assert two <= one


@pytest.mark.parametrize("m,n,want", [(202112, 1, 202201), (202101, -1, 202012), (202103, 24, 202303), (202112, 0, 202112)])
def test_period_arithmetic(spark, m, n, want):
    row = spark.range(1).select(
        add_periods(F.lit(m), n).alias("a"), index_period(period_index(F.lit(m))).alias("b"),
        periods_between(F.lit(m), F.lit(want)).alias("d"),
    ).first()
    assert (row.a, row.b, row.d) == (want, m, n)


def test_lags_are_by_row_and_calendar_lags_by_month(small):
    rows = _by_key(H.add(small, H.lags(["x"]), H.calendar_lags(["x"]), H.calendar_lags(["x"], 2), H.deltas(["x"], 2), H.history_depth()))
    gap = rows[1, 202106]
    assert gap.x__lag1 is None and gap.x__mes1 is None and gap.x__mes2 is None and gap.x__delta2 == 20.0
    assert rows[3, 202105].x__lag1 == 5.0 == rows[3, 202105].x__mes1
    assert gap.n_historia == 2


def test_slope_needs_two_points_and_a_moving_axis(small):
    rows = _by_key(H.add(small, H.slopes(["x"], "t"), H.slopes(["x"], "t", H.last_rows(3), "slope3")))
    assert rows[1, 202106].x__slope == pytest.approx(20 / 3) == rows[1, 202106].x__slope3
    assert rows[1, 202103].x__slope is None and rows[3, 202105].x__slope is None and rows[2, 202103].x__slope is None


def _flags(spark, flags):
    return spark.createDataFrame([(1, 202101 + i, f) for i, f in enumerate(flags)], f"{E} long, {P} int, f int")


def test_recency_and_streaks(spark):
    flags = [1, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 0]
    panel = H.open_streak(_flags(spark, flags), "f", "abierta")
    rows = H.add(panel, {"rec": H.recency(F.col("f") == 1), "racha": H.streak("f")}).orderBy(P).collect()
    assert [r.rec for r in rows] == [0, 1, 2, 3, 3, 0, 0, 0, 0, 0, 0, 1]
    assert [r.racha for r in rows] == [1, 0, 0, 0, 0, 1, 2, 3, 4, 4, 4, 0]
    assert [r.abierta for r in rows] == [1, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 0]


def test_onset_is_unknown_without_history(spark):
    panel = _flags(spark, [0, 3, 0, 0])
    rows = H.add(panel, {"o": H.onset(F.col("f") == 0, lambda w: F.lag("f", 1).over(w) > 0)}).orderBy(P).collect()
    assert [r.o for r in rows] == [None, 0, 1, 0]


def test_growth_keeps_its_sign_on_a_negative_base(spark):
    panel = spark.createDataFrame([(1, 202101, -10.0), (1, 202102, -5.0), (1, 202103, 0.0), (1, 202104, 3.0)], f"{E} long, {P} int, x double")
    rows = H.add(panel, H.growth(["x"])).orderBy(P).collect()
    assert [r.x__crec1 for r in rows] == [None, 0.5, 1.0, None]


def test_two_ratios_differ_on_null(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    rows = df.select(S.safe_ratio("a", "b").alias("s"), S.ratio("a", "b").alias("r"), S.clamped_ratio("a", F.lit(-1.0)).alias("c")).collect()
    assert [r.s for r in rows] == [0.0, None, None, 1.5]
    assert [r.r for r in rows] == [None, None, None, 1.5]
    assert all(r.c is None for r in rows)


def test_repair_changes_only_its_period(spark):
    panel = spark.createDataFrame(
        [(1, 202105, 100.0, 1, 0), (1, 202106, 150.0, 1, 0), (2, 202106, 90.0, 2, 5), (3, 202106, 90.0, 1, None)],
        f"{E} long, {P} int, mpayroll double, cpayroll_trx int, z int",
    )
    evidence = Q.bonus_month(202106, "mpayroll", "cpayroll_trx")
    rows = _by_key(panel.withColumns({
        "m": Q.without_bonus("mpayroll", evidence, False), "c": Q.without_bonus("cpayroll_trx", evidence, True),
        "v": Q.zero_where_injected("cpayroll_trx", "z", [202105]), "k": Q.carried("mpayroll", 202106),
    }))
    assert rows[1, 202105].m == 100.0 and rows[1, 202106].m == 100.0 and rows[2, 202106].m == 60.0 and rows[3, 202106].m == 90.0
    assert rows[2, 202106].c == 1 and rows[1, 202106].c == 1
    assert rows[1, 202105].v == 0 and rows[1, 202106].v == 1
    assert rows[1, 202106].k == 100.0 and rows[2, 202106].k == 90.0


def test_history_panel_shares_one_exchange(spark):
    cols = [f"m{i}" for i in range(12)]
    panel = spark.range(50).select(F.col("id").alias(E), F.lit(202101).alias(P), *[F.rand(i).alias(c) for i, c in enumerate(cols)]).repartition(3)
    plan = D.full_history(panel, cols)._jdf.queryExecution().sparkPlan().toString()
    physical = D.full_history(panel, cols)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and physical.count("Exchange hashpartitioning") == 1


def test_selectors(spark):
    df = spark.createDataFrame([], f"{E} long, {P} int, {L} string, mx double, Visa_mx double, Visa_status int, mx__lag1 float, es_baja boolean, k int")
    assert C.numeric_predictors(df) == ["mx", "Visa_mx", "Visa_status", "mx__lag1"]
    assert C.amount_columns(df.columns) == ["mx", "Visa_mx"] and C.own_amounts([*df.columns, "mes_ultimo"]) == ["mx"]
    assert C.family("mx__lag1") == "mx"
    with pytest.raises(ValueError, match="not in the panel"):
        C.allow_list(df, ["mx", "nada"])
