"""Selection, panels stored by entity, presence bits, trees as a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators import forest, history, label, models, presence, selection
from panelmill.operators import targets as T
from panelmill.sources import by_entity

E, P, L = K.ENTITY, K.PERIOD, K.LABEL


# --- selection --------------------------------------------------------------------------------

def _medians(rows):
    return {(r[P], r.feature): r.mediana for r in rows.collect()}


def test_selection_orders_under_one_percent(spark):
    rng = np.random.default_rng(3)
    data = [(202103 + int(i % 2), float(x), float(round(x))) for i, x in enumerate(rng.lognormal(8, 3, 60_000))]
    panel = spark.createDataFrame(data, f"{P} int, a double, b double").checkpoint()
    held = selection.counts_around(panel, [F.col("a")], 0.5)
    assert held.count() < 0.01 * len(data)
    got = _medians(selection.selected_quantile(panel, ["a", "b"], 0.5, "mediana"))
    for period in (202103, 202104):
        for i, name in ((1, "a"), (2, "b")):
            assert got[period, name] == pytest.approx(np.median([r[i] for r in data if r[0] == period]), abs=0)


def test_selection_with_ties_nulls_nan_and_null_periods(spark):
    data = [(1, x) for x in [5.0] * 900 + [1.0] * 450 + [9.0] * 451] + [(2, None), (3, float("nan")), (3, 1.0), (3, float("nan"))]
    data += [(None, 2.0), (None, 4.0)]
    panel = spark.createDataFrame(data, f"{P} int, a double")
    got = _medians(selection.selected_quantile(panel, ["a"], 0.5, "mediana"))
    assert got[1, "a"] == 5.0 and np.isnan(got[3, "a"]) and got[None, "a"] == 3.0 and (2, "a") not in got
    assert selection.selected_quantile(panel.limit(0), ["a"], 0.5, "mediana").count() == 0


def test_selection_is_exact_where_the_sketch_misses(spark, monkeypatch):
    monkeypatch.setattr(selection, "ACCURACY", 3)
    data = [(1, float(x)) for x in np.random.default_rng(4).permutation(5_001)]
    got = _medians(selection.selected_quantile(spark.createDataFrame(data, f"{P} int, a double"), ["a"], 0.25, "mediana"))
    assert got == {(1, "a"): 1250.0}


def test_selection_folds_values_before_they_are_rows(spark, monkeypatch):
    """Every cell became a row of its own before it was counted; with too many periods to look up in the tasks it still does, to the same end."""
    rng = np.random.default_rng(5)
    data = [(None if i % 3 == 0 else i % 3, *(None if rng.random() < 0.2 else float(v) for v in rng.choice([-0.0, 1.5, 2.5, 7.0, float("nan")], 2))) for i in range(3_000)]
    panel = spark.createDataFrame(data, f"{P} int, a double, b double").checkpoint()
    told = selection.counts_around(panel, [F.col("a"), F.col("b")], 0.5)
    assert "Generate" not in told._jdf.queryExecution().optimizedPlan().toString()
    key = lambda rows: sorted(str(tuple(r)).replace("-0.0", "0.0") for r in rows.collect())
    got = key(told)
    monkeypatch.setattr(selection, "BROADCAST_BYTES", 0)
    joined = selection.counts_around(panel, [F.col("a"), F.col("b")], 0.5)
    assert "Generate" in joined._jdf.queryExecution().optimizedPlan().toString() and key(joined) == got


# --- panels by entity -------------------------------------------------------------------------

def test_label_history_and_repairs_read_the_layout_without_exchange(spark):
    rng = np.random.default_rng(6)
    rows = [(e, 202103 + m, float(e + m)) for e in range(200) for m in range(6) if rng.random() < 0.8]
    stored = by_entity.stored_by_entity(spark.createDataFrame(rows, f"{E} long, {P} int, x double"), 4)
    base = label.build_base(stored)
    other = stored.select(E, P, (F.col("x") * 2).alias("x"), F.lit(1).alias("y"))
    other = history.add(other, history.lags(["x"]))
    joined = history.add(by_entity.with_columns_of(base, other.filter(f"{P} <> 202104")), history.deltas(["x"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        got = {(r[E], r[P]): r for r in joined.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
    assert len(got) == len(rows)
    for e, p, x in rows:
        assert got[e, p].x == (None if p == 202104 else 2 * x)


def test_an_existing_layout_stays_unless_forced(spark, tmp_path):
    panel, path = spark.createDataFrame([(1, 202103, 2.0)], f"{E} long, {P} int, x double"), str(tmp_path / "t")
    by_entity.write_by_entity(panel, "panel_guardado", 2, path)
    with pytest.raises(Exception, match="(?i)already exists"):
        by_entity.write_by_entity(panel, "panel_guardado", 2, path)
    by_entity.write_by_entity(panel.withColumn("x", F.lit(3.0)), "panel_guardado", 2, path, force=True)
    assert [tuple(r) for r in by_entity.read_by_entity(spark, "panel_guardado", ["x"]).collect()] == [(1, 202103, 3.0)]
    spark.sql("drop table panel_guardado")


# --- presence ---------------------------------------------------------------------------------

def test_bits_give_what_windows_give(spark):
    rng = np.random.default_rng(7)
    months = [202001 + 100 * (m // 12) + m % 12 for m in range(70)]  # more than one word of bits
    rows = [(e, p) for e in range(40) for p in months if rng.random() < 0.7]
    panel = spark.createDataFrame(rows + rows[:50] + [(1, None)], f"{E} long, {P} int")
    want = label.build_base(spark.createDataFrame(rows, f"{E} long, {P} int"))
    bits = presence.bitmaps(panel)
    got = presence.base_rows(bits).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    seen = {(r[E], r[P]) for r in presence.presence_rows(bits).collect() if r.presente}
    assert seen == set(rows)
    gaps = {(r[E], r[P]): r.hueco for r in presence.base_rows(bits).collect()}
    own = {e: [months.index(p) for x, p in rows if x == e] for e in range(40)}
    assert gaps == {(e, months[b]): b - a - 1 for e, v in own.items() for a, b in zip([v[0] - 1, *v], v)}
    assert presence.base_rows(presence.bitmaps(panel.limit(0))).count() == 0


def test_bits_shuffle_the_panel_once(spark):
    panel = spark.range(100).select(F.col("id").alias(E), (F.col("id") % 5 + 202103).cast("int").alias(P)).repartition(3)
    plan = presence.base_rows(presence.bitmaps(panel))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


# --- forests ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 202103, float(rng.normal()), None if i % 7 == 0 else float(rng.integers(0, 5)), float(i % 3 == 0), 1.0) for i in range(400)]
    panel = spark.createDataFrame(rows, f"{E} long, {P} int, x double, z double, {T.Y} double, {T.WEIGHT} double")
    data = models.assembled(panel, ["x", "z"], (E, P, T.Y, T.WEIGHT)).cache()
    return data, {s: models.fit(data, s, {"maxIter": n, "maxDepth": 3}) for s, n in ((11, 3), (12, 2))}


@pytest.mark.parametrize("room", [1 << 20, 64])
def test_a_forest_scores_as_its_models_do(spark, fitted, monkeypatch, room):
    data, fits = fitted
    monkeypatch.setattr(forest, "BROADCAST_BYTES", room)  # 64: a scan for each model
    got = {(r[E], r.modelo): r.score for r in forest.forest_scores(forest.forest_of(fits, spark), data, (E,)).collect()}
    want = {(r[E], s): r.score for s, m in fits.items() for r in models.score(m, data).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_a_forest_scores_all_models_in_one_scan(spark, fitted):
    data, fits = fitted
    plan = forest.forest_scores(forest.forest_of(fits, spark), data, (E,))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1
