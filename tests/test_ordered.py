"""Distributed ranks, sums and quantiles against pandas, with hot values and several blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators import ordered as O
from panelmill.operators import ranks as R
from panelmill.functions import keys as K

pytestmark = pytest.mark.usefixtures("many_blocks")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3_000
    value = np.where(rng.random(n) < 0.35, 0.0, rng.integers(-40, 400, n) / 4)  # a third of the rows share one value
    value = np.where(rng.random(n) < 0.1, np.nan, value)
    group = np.where(rng.random(n) < 0.6, "a", rng.choice(["b", "c", "d"], n))
    return pd.DataFrame({"g": group, "id": np.arange(n), "value": value, "w": rng.integers(0, 5, n)})


def _spark(spark, frame):
    return spark.createDataFrame(frame).withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))


def _blocks_of(spark, frame, second=None):
    return O._in_blocks(_spark(spark, frame), ["g"], F.col("value"), second).groupBy("_key").count().select("_key.*", "count").toPandas()


def test_groups_are_cut_into_even_blocks(spark, frame):
    """A group of 60 % of the rows, a third of them one value and a tenth NULL, fills no block beyond a few quantiles."""
    whole = frame.groupby("g").size()
    for second in (None, F.col("id")):
        blocks = _blocks_of(spark, frame, second)
        share = blocks["count"] / blocks["g"].map(whole)
        assert share.max() <= 2.5 / O._blocks(spark)


def test_rows_are_shuffled_once(spark, frame):
    df = O.running_sums(_spark(spark, frame), ["g"], [F.col("id").asc()], [F.col("id")], {"rn": F.lit(1)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4  # the rows; the block table by block, by group, by block


def test_null_groups_are_groups(spark):
    rows = spark.createDataFrame([(None, 1, 5.0), (None, 2, 5.0), ("a", 3, 1.0), ("a", 4, None)], "g string, id long, value double")
    sums = O.running_sums(rows, ["g"], [F.col("id").asc()], [F.col("id")], {"s": F.lit(1)}).orderBy("id").collect()
    assert [(r.g, r.s, r.s_total) for r in sums] == [(None, 1, 2), (None, 2, 2), ("a", 1, 2), ("a", 2, 2)]
    ranks = O.with_value_ranks(rows, ["g"], "value", {"r": "rank", "f": "rank_fraction"}).orderBy("id").collect()
    assert [(r.r, r.f) for r in ranks] == [(1, 0.75), (1, 0.75), (1, 0.5), (2, 1.0)]


def test_value_shared_by_nine_tenths(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": "a", "id": np.arange(4_000), "value": np.where(rng.random(4_000) < 0.9, 7.0, rng.normal(7, 3, 4_000))})
    got = O.with_value_ranks(spark.createDataFrame(frame), ["g"], "value", {"r": "rank", "d": "dense_rank", "c": "cume_dist"}).toPandas()
    by = got["value"].rank(method="min")
    assert (got["r"] == by).all() and (got["d"] == got["value"].rank(method="dense")).all()
    np.testing.assert_allclose(got["c"], got["value"].rank(method="max") / 4_000)
    blocks = _blocks_of(spark, frame)
    assert blocks["count"].max() <= 4_000 * 2.5 / O._blocks(spark)


@pytest.mark.parametrize("group", [["g"], []])
def test_running_sums(spark, frame, group):
    order = [F.col("w").desc(), F.col("id").asc()]
    got = O.running_sums(_spark(spark, frame), group, order, [-F.col("w"), F.col("id")], {"rn": F.lit(1), "s": F.col("w")}).toPandas()
    want = frame.sort_values(["w", "id"], ascending=[False, True])
    by = want.groupby("g") if group else want.assign(_="").groupby("_")
    want = want.assign(rn=by.cumcount() + 1, s=by["w"].cumsum(), s_total=by["w"].transform("sum"))
    merged = got.merge(want, on="id", suffixes=("", "_want"))
    assert len(merged) == len(frame)
    for c in ("rn", "s", "s_total"):
        assert (merged[c] == merged[f"{c}_want"]).all()


def test_value_ranks_match_pandas(spark, frame):
    names = {f: f for f in ("percent_rank", "cume_dist", "rank", "dense_rank", "rank_average", "rank_fraction")}
    got = O.with_value_ranks(_spark(spark, frame), ["g"], "value", names).toPandas().set_index("id").sort_index()
    by = frame.groupby("g")["value"]
    low, mid = by.rank(method="min", na_option="bottom"), by.rank(method="average", na_option="bottom")
    size = by.transform("size")
    np.testing.assert_array_equal(got["rank"], low)
    np.testing.assert_array_equal(got["dense_rank"], by.rank(method="dense", na_option="bottom"))
    np.testing.assert_array_equal(got["rank_average"], mid)
    np.testing.assert_allclose(got["rank_fraction"], mid / size, rtol=0, atol=1e-15)
    np.testing.assert_allclose(got["percent_rank"], (low - 1) / (size - 1), rtol=0, atol=1e-15)
    assert got["rank_fraction"].between(0, 1, inclusive="right").all()


def test_quantiles_match_numpy(spark, frame):
    got = O.group_quantiles(_spark(spark, frame), ["g"], "value", {"p10": 0.1, "median": 0.5, "max": 1.0}).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        x = part["value"].dropna()
        np.testing.assert_allclose(got.loc[g, ["p10", "median", "max"]].astype(float), np.quantile(x, [0.1, 0.5, 1.0]))


@pytest.mark.parametrize("k", [1, 3, 4, 10, 5_000])
def test_ntile(spark, frame, k):
    numbered = O.row_numbers(spark.createDataFrame(frame[["g", "id"]]), ["g"], [F.col("id").asc()], [F.col("id")])
    got = numbered.withColumn("t", O.ntile_of(k, F.col("rn"), F.col("n")))
    got.createOrReplaceTempView("tiles")
    wrong = spark.sql(f"select * from (select *, ntile({k}) over (partition by g order by id) as want from tiles) where t <> want")
    assert wrong.count() == 0


@pytest.mark.parametrize("nulls", ["last", "keep"])
@pytest.mark.parametrize("replace", [True, False])
def test_period_ranks_match_windows_at_every_size(spark, frame, nulls, replace):
    panel = _spark(spark, frame).withColumnsRenamed({"id": K.ENTITY, "value": "mx"}).withColumn(
        K.PERIOD, F.when(F.col("g") == "a", 202103).otherwise(202104)
    ).withColumn("my", F.col("w").cast("double")).drop("g")
    functions = ("percent_rank",) if replace else ("percent_rank", "cume_dist", "rank", "dense_rank")
    got = R.period_ranks(panel, ["mx", "my"], functions, nulls, replace)
    few = R.period_ranks(panel.limit(3), ["mx", "my"], functions, nulls, replace)
    assert got.schema == few.schema  # the path and the types do not depend on the size
    known = {c: F.col(c).isNotNull() | F.lit(nulls == "last") for c in ("mx", "my")}
    order = {c: Window.partitionBy(K.PERIOD).orderBy(F.col(c).asc_nulls_last()) for c in known}
    want = panel.select(K.ENTITY, *[
        F.when(known[c], getattr(F, f)().over(order[c])).alias(c if replace else f"{c}__{f}") for c in known for f in functions
    ])
    a, b = (x.toPandas().sort_values(K.ENTITY).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a[list(b.columns)], b, check_dtype=False)


def test_zero_fixed_rank_keeps_sign_and_zero(spark, frame):
    panel = _spark(spark, frame).withColumnsRenamed({"id": K.ENTITY, "value": "mx"}).withColumn(K.PERIOD, F.lit(202103))
    got = R.zero_fixed_ranks(panel, ["mx"]).toPandas()
    known = got.dropna(subset=["mx"])
    assert (np.sign(known["mx"]) == np.sign(known["mx__rank_cero_fijo"])).all()
    assert known["mx__rank_cero_fijo"].abs().max() == 1.0
    assert got.loc[got["mx"].isna(), "mx__rank_cero_fijo"].isna().all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_groups_are_never_joined_by_their_key(spark, monkeypatch):
    """3,000 groups whose split points do not fit: fewer blocks each, still broadcast; and one block each where even that is too much."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": rng.integers(0, 3_000, 30_000), "id": np.arange(30_000), "value": rng.integers(0, 50, 30_000) / 2})
    want = frame.groupby("g")["value"].rank(method="min")
    whole = O._blocks(spark)
    for size, blocks in ((16 * whole * 3_000, whole), (16 * whole * 1_500, whole // 2), (1, 1)):
        monkeypatch.setattr(O, "SPLIT_BYTES", size)
        rows = O._in_blocks(spark.createDataFrame(frame), ["g"], F.col("value"), None)
        assert "SortMergeJoin" not in _plan(rows) and "ShuffledHashJoin" not in _plan(rows)
        most = rows.groupBy("_key.g").agg(F.countDistinct("_key").alias("n")).agg(F.max("n")).first()[0]
        assert most <= 2 * blocks and (blocks > 1) == (most > 1)
        got = O.with_value_ranks(spark.createDataFrame(frame), ["g"], "value", {"r": "rank"}).toPandas().set_index("id")["r"].sort_index()
        assert (got.to_numpy() == want.to_numpy()).all()


def test_only_rare_cells_are_shuffled_to_be_ranked(spark, frame):
    """A third of the cells are zero and a tenth NULL: they are counted at home, and the filter stands below the exchange."""
    panel = _spark(spark, frame).withColumnsRenamed({"id": K.ENTITY, "value": "mx"}).withColumn(K.PERIOD, F.lit(202103)).withColumn("flag", F.col("w") % 2).drop("g")
    points, parts = R._points(panel, ["mx", "flag"])
    rows = R.coded(panel, ["mx", "flag"], points, parts)
    rare = R.rare_cells(rows, ["mx", "flag"]).toPandas()
    assert set(rare.feature) == {"mx"}  # a flag has two values, both frequent
    values = frame["value"].dropna()
    assert len(rare) <= (values != 0).sum() and (rare.value != 0).all()
    plan = _plan(R.rare_cells(rows, ["mx", "flag"]).repartition(K.ENTITY))
    assert plan.index("Exchange hashpartitioning") < plan.index("Filter")  # the plan is printed from the top


def test_facts_beyond_their_bytes_leave_fewer_parts(spark, frame, monkeypatch):
    monkeypatch.setattr(R, "FACTS_BYTES", 2_000)
    panel = _spark(spark, frame).withColumnsRenamed({"id": K.ENTITY, "value": "mx"}).withColumn(K.PERIOD, F.lit(202103)).drop("g")
    got = R.period_ranks(panel, ["mx"], ("rank", "cume_dist")).toPandas().set_index(K.ENTITY).sort_index()
    assert R._points(panel, ["mx"])[0].select(F.max(F.size("_p_0"))).first()[0] < 63
    np.testing.assert_array_equal(got["mx__rank"], frame["value"].rank(method="min", na_option="bottom"))
    np.testing.assert_allclose(got["mx__cume_dist"], frame["value"].rank(method="max", na_option="bottom") / len(frame))


def test_cells_are_the_long_form_without_names(spark):
    """Every shuffled row carried its column's name, as text; the place in the list of columns tells as much."""
    from panelmill.operators.ordered import cells, named, unpivot

    panel = spark.createDataFrame([(1, 2.5, 3), (2, None, 4), (None, 0.0, None)], "k int, a double, b int")
    for keep_nulls in (True, False):
        long = cells(panel, ["k"], ["a", "b"], keep_nulls)
        assert [f.dataType.simpleString() for f in long.schema] == ["int", "int", "double"]
        assert sorted(map(str, named(long, ["a", "b"]).collect())) == sorted(map(str, unpivot(panel, ["k"], ["a", "b"], keep_nulls).collect()))
