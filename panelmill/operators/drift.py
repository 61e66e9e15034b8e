"""Does a column move between periods, and does its relation to the label move?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators.ordered import cells, group_quantiles, named
from panelmill.operators.ranking import auc_from_values
from panelmill.session import broadcast_if_small, checkpoint

P, L = K.PERIOD, K.LABEL


def univariate_auc(panel: DataFrame, columns: Sequence[str], positive: str = K.LEAVES_IN_TWO, nulls: str = "bottom",
                   by_period: bool = True) -> DataFrame:
    """(period, feature, auc) of each column alone against the class.

    `nulls`: "bottom" ranks NULL below every value ("does not own it"), "top" above.
    """
    y = F.coalesce(F.col(L) == positive, F.lit(False)).cast("int")
    keep = [P, "_y"] if by_period else ["_y"]
    long = cells(panel.withColumn("_y", y), keep, columns)
    if nulls == "bottom":
        long = long.withColumn("value", F.coalesce("value", F.lit(float("-inf"))))
    group = [P, "place"] if by_period else ["place"]
    return named(auc_from_values(long, group, "value", F.col("_y")), columns)


def signal(aucs: DataFrame) -> DataFrame:
    """Add the distance from 0.5 and the direction of each AUC."""
    return aucs.withColumns({
        "distancia": F.abs(F.col("auc") - 0.5), "direccion": F.when(F.col("auc") < 0.5, "menos").otherwise("mas")
    })


def psi(panel: DataFrame, columns: Sequence[str], reference: int, current: int, bins: int = 10) -> DataFrame:
    """(feature, psi): population stability between two periods on the reference's quantile bins.

    Equal edges are merged, values outside the edges are dropped, the last bin is closed.
    Columns with fewer than three distinct edges get NULL.
    """
    long = cells(panel.filter(F.col(P).isin(reference, current)), [P], columns, keep_nulls=False)
    # edges and bins both come of these counts, so the panel itself is read once
    counts = checkpoint(long.groupBy(P, "place", "value").agg(F.count(F.lit(1)).alias("n")))
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = group_quantiles(counts.filter(F.col(P) == reference), ["place"], "value", names, "n").select(
        "place", F.array_sort(F.array_distinct(F.array(*names))).alias("_edges")
    )
    edges = broadcast_if_small(edges, 16 + 8 * len(names))
    binned = counts.join(edges, "place").filter(
        (F.size("_edges") >= 3) & F.col("value").between(F.element_at("_edges", 1), F.element_at("_edges", -1))
    )
    bin_ = F.least(F.size(F.filter("_edges", lambda e: e <= F.col("value"))), F.size("_edges") - 1)
    sums = binned.groupBy("place", (F.size("_edges") - 1).alias("_bins"), bin_.alias("_bin")).agg(
        F.sum(F.when(F.col(P) == reference, F.col("n")).otherwise(0)).alias("e"),
        F.sum(F.when(F.col(P) == current, F.col("n")).otherwise(0)).alias("a"),
    )
    whole = Window.partitionBy("place")
    tiny = F.lit(1e-10)
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1)) + tiny
    shares = sums.withColumns({"_a": share("a"), "_e": share("e")})
    gap = (F.col("_a") - F.col("_e")) * F.ln(F.col("_a") / F.col("_e"))
    # A bin empty in both periods has equal shares and adds nothing, so missing bins need no row.
    measured = shares.groupBy("place").agg(F.sum(gap).alias("psi"))
    return named(edges.select("place").join(measured, "place", "left"), columns)


def concept_drift(panel: DataFrame, columns: Sequence[str], periods: Sequence[int], most_psi: float = 0.1,
                  least_signal: float = 0.02) -> DataFrame:
    """Columns whose distribution stays while their relation to the class moves, by AUC range.

    The full table; `candidata` marks the ones that pass both thresholds.
    """
    aucs = univariate_auc(panel.filter(F.col(P).isin(*periods)), columns, nulls="top")
    at = lambda p: F.max(F.when(F.col(P) == p, F.col("auc")))
    table = aucs.groupBy("feature").agg(
        *[at(p).alias(f"auc_{p % 100:02d}") for p in periods],
        (F.max("auc") - F.min("auc")).alias("rango_auc"),
        (at(periods[-1]) - at(periods[0])).alias("deriva"),
        F.max(F.abs(F.col("auc") - 0.5)).alias("senal_max"),
        F.count("auc").alias("_n"),
    ).filter(F.col("_n") == len(periods)).drop("_n")
    stability = psi(panel, columns, periods[0], periods[-1])
    return table.join(stability, "feature").withColumn(
        "candidata", F.coalesce((F.col("psi") < most_psi) & (F.col("senal_max") > least_signal), F.lit(False))
    )


def comoments(rows: DataFrame) -> DataFrame:
    """(n, means, moments): of all double columns together, the rows, the means and the sums of products of differences from them.

    Each task folds its Arrow batches; one small row per task is shuffled, and these are merged the same way.
    """
    width = len(rows.columns)

    def merged(a, b):
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def told(state) -> pa.RecordBatch:
        cells = [[state[0]], [state[1].tolist()], [state[2].ravel().tolist()]]
        return pa.RecordBatch.from_pydict({"n": pa.array(cells[0], pa.int64()), **{
            k: pa.array(v, pa.list_(pa.float64())) for k, v in zip(("means", "moments"), cells[1:])}})

    def fold(batches):
        state = None
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                means = x.mean(axis=0)
                x -= means
                state = merged(state, (b.num_rows, means, x.T @ x))
        if state:
            yield told(state)

    def merge(batches):
        state = None
        for b in batches:
            for n, means, moments in zip(*[c.to_pylist() for c in b.columns]):
                state = merged(state, (n, np.array(means), np.array(moments).reshape(width, width)))
        if state:
            yield told(state)

    schema = "n long, means array<double>, moments array<double>"
    return rows.mapInArrow(fold, schema).repartition(1).mapInArrow(merge, schema)


def correlated_pairs(panel: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """(a, b, r) for column pairs with |r| at or above the threshold; NULL counts as 0. A constant column has no correlation.

    The correlation matrix is one distributed pass; only its cells come to the driver.
    """
    filled = panel.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    all_rows = comoments(filled).first()
    if all_rows is None or all_rows.n < 2:
        raise ValueError("a correlation needs two rows or more")
    covariance = np.array(all_rows.moments).reshape(len(columns), len(columns)) / (all_rows.n - 1)
    variance = covariance.diagonal()
    deviation = np.where(variance <= 1e-12, np.nan, np.sqrt(variance))
    matrix = covariance / np.outer(deviation, deviation)
    rows = [
        (a, b, float(matrix[i, j]))
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j and abs(matrix[i, j]) >= threshold
    ]
    return panel.sparkSession.createDataFrame(rows, "a string, b string, r double")


def drop_correlated(pairs: DataFrame, importance: Mapping[str, float] | DataFrame) -> DataFrame:
    """Of each pair, the column to drop: the less important one (the later name on a tie)."""
    if not isinstance(importance, DataFrame):
        importance = pairs.sparkSession.createDataFrame(list(importance.items()), "feature string, importancia double")
    side = lambda n: importance.select(F.col("feature").alias(n), F.col("importancia").alias(f"_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select(
        F.when(F.col("_a") >= F.col("_b"), F.col("b")).otherwise(F.col("a")).alias("feature")
    ).distinct()
