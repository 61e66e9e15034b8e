"""Differences of two large stored tables that read only what differs.

A table is stored in buckets by a hash of its key, with an order-free digest of each bucket beside it. Digests add up, so those of a range
of buckets are sums: two tables are compared from the whole table down to the buckets, and only rows of buckets that differ are read.
Equal digests are taken for equal rows: two sums of 32 bits of SHA-256 each, and the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.label import differences
from panelmill.operators.ledger import table_digest

BUCKET = "_cubo"
#: Buckets under one node of the tree.
FAN = 16


def store(df: DataFrame, path: str, key: Sequence[str], buckets: int = 256) -> None:
    """The table in one folder per bucket and its digests. Rows whose key is NULL have a bucket too."""
    placed = df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    placed.repartition(buckets, BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{path}/rows")
    placed.limit(0).coalesce(1).write.mode("errorifexists").parquet(f"{path}/columns")  # an empty table has no files to tell them
    spark = df.sparkSession
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")  # what was written, not what was meant
    table_digest(stored, [BUCKET]).coalesce(1).write.mode("errorifexists").parquet(f"{path}/digests")


def _level(digests: DataFrame, span: int, within: DataFrame | None) -> DataFrame:
    """Nodes of `span` buckets that differ, under those of the level above that do."""
    at = digests.withColumn("_node", F.floor(F.col(BUCKET) / span))
    if within is not None:
        above = F.floor(F.col(BUCKET) / (span * FAN))
        at = at.join(F.broadcast(within.withColumnRenamed("_node", "_above")), above == F.col("_above"), "left_semi")
    sums = [F.sum(F.col("_lado") * F.col(c)).alias(c) for c in ("filas", "huella_1", "huella_2")]
    return at.groupBy("_node").agg(*sums).filter("filas <> 0 or huella_1 <> 0 or huella_2 <> 0").select("_node")


def differing_buckets(spark: SparkSession, left: str, right: str) -> list[int]:
    """Buckets whose digests differ, found from the top; at most as many as there are buckets."""
    digests = spark.read.parquet(f"{left}/digests").withColumn("_lado", F.lit(1)).unionByName(
        spark.read.parquet(f"{right}/digests").withColumn("_lado", F.lit(-1)))
    top = digests.agg(F.max(BUCKET)).first()[0]
    if top is None:
        return []
    span = 1
    while span <= top:
        span *= FAN
    nodes = None
    while span:
        nodes = _level(digests, span, nodes)
        span //= FAN
    return sorted(r[0] for r in nodes.collect())


def rows_of(spark: SparkSession, path: str, buckets: Sequence[int], schema) -> DataFrame:
    """Rows of some buckets; the folders of the others are not read."""
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.filter(F.col(BUCKET).isin(*buckets)) if buckets else rows.filter(F.lit(False))


def tree_differences(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Rows that only one of two stored tables holds, as often as the other lacks them, marked by side.

    Both must be stored by the same key and number of buckets, with the same columns.
    """
    both = [spark.read.parquet(f"{p}/columns").schema for p in (left, right)]
    if sorted(both[0].names) != sorted(both[1].names):
        raise ValueError("tables with different columns have no rows in common")
    buckets = differing_buckets(spark, left, right)
    a, b = (rows_of(spark, p, buckets, s) for p, s in zip((left, right), both))
    return differences(a, b).drop(BUCKET)
