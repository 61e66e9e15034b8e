"""What the panel jobs shuffle, read from their plans, and that NULL keys keep their ranks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators import ranks as R
from panelmill.plans.panels import bank_panel


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _panel(spark):
    rng = np.random.default_rng(8)
    n = 3_000
    rows = pd.DataFrame({"e": range(n), "p": rng.choice([202101, 202102], n), "mx": np.where(rng.random(n) < 0.3, 0, rng.integers(-900, 900, n)).astype(float)})
    rows.loc[rng.random(n) < 0.1, "mx"] = np.nan
    known = spark.createDataFrame(rows).withColumn("mx", F.when(~F.isnan("mx"), F.col("mx")))
    return rows, known.select(
        F.when(F.col("e") > 1, F.col("e")).alias(K.ENTITY), F.when(F.col("p") > 202101, F.col("p")).alias(K.PERIOD), "e", "mx"
    ).filter("e <> 1")


def test_facts_of_a_period_are_joined_after_the_rows_are_shuffled(spark):
    """Joined before, every row carried its period's arrays of all codes and columns through the exchange."""
    joins = [line for line in _plan(R.period_ranks(_panel(spark)[1], ["mx"])).splitlines() if "Join" in line]
    assert "_period" in joins[0] and "_entity" in joins[1]  # printed from the top: facts come last


def test_ranks_of_null_periods_and_entities(spark):
    rows, panel = _panel(spark)
    rows = rows[rows.e != 1]
    got = R.period_ranks(panel, ["mx"], ("rank", "rank_average")).toPandas().set_index("e").sort_index()
    for method, name in (("min", "rank"), ("average", "rank_average")):
        want = rows.groupby("p")["mx"].rank(method=method, na_option="bottom")
        np.testing.assert_array_equal(got[f"mx__{name}"].to_numpy(float), want.to_numpy())


def test_measures_are_never_shuffled(spark):
    """The customer's shuffle takes orders; sums and history windows stand on it without another exchange."""
    panel = bank_panel(spark, "/root/testdata/sf0.001", ["mcuentas_saldo"])
    plan = _plan(panel.withColumn("n", F.lag("mcuentas_saldo").over(R.Window.partitionBy(K.ENTITY).orderBy(K.PERIOD))))
    assert plan.count("Exchange hashpartitioning") == 1
