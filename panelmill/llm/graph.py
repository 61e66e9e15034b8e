"""Connected components of an edge table, in the cluster.

Star contraction: an edge (u, v), u > v, becomes (u, least neighbour of v), which halves paths; then the smaller
neighbours of each node are hung on the least of them, which makes stars. Rows never exceed the edges given.
Least neighbours and edges are checkpointed, so both sides of each join are plain exchanges and adaptive execution
can split a node that touches a third of all others. The driver sees whether anything is left to do, no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.session import checkpoint


def _least(edges: DataFrame) -> DataFrame:
    return checkpoint(edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))


def _flat(edges: DataFrame) -> DataFrame:
    return checkpoint(edges.select("u", "v").filter("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (a, b: longs) that has a link; the component is its smallest node.

    Links of a node to itself and repeated links count for nothing; rows with a null end are ignored.
    """
    pairs = _flat(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        least = _least(pairs)
        up = pairs.join(least, F.col("v") == F.col("x"), "left")
        stars = least.filter("n > 1").isEmpty() and up.filter("m is not null").isEmpty()
        if stars:
            break
        pairs = _flat(up.select("u", F.coalesce("m", "v").alias("v")))
        hung = pairs.join(_least(pairs), F.col("u") == F.col("x"))
        pairs = _flat(hung.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*"))
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
