"""Panels stored by entity: bucketed and sorted tables that label, history and column repairs read without an exchange.

All tables of one layout have the same number of buckets. Windows over an entity and joins by entity then find their rows in place.
Every bucket is one file, written by one task; with many entities a bucket, no entity decides its size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.sources.files import shared_folder

E, P = K.ENTITY, K.PERIOD


def write_by_entity(panel: DataFrame, name: str, buckets: int, path: str | None = None, force: bool = False) -> None:
    """The panel as a table of `buckets` files by entity, each sorted by entity and period. An existing table stays unless `force`."""
    writer = panel.repartition(buckets, E).write.mode("overwrite" if force else "errorifexists")
    writer = writer.bucketBy(buckets, E).sortBy(E, P).option("compression", "zstd")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def read_by_entity(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    stored = spark.read.table(name)
    return stored if columns is None else stored.select(E, P, *[c for c in columns if c not in (E, P)])


def stored_by_entity(panel: DataFrame, buckets: int | None = None) -> DataFrame:
    """The panel, written once beside the checkpoints and read back in its layout."""
    spark = panel.sparkSession
    name = f"panel_{uuid.uuid4().hex}"
    write_by_entity(panel, name, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark, name))
    return read_by_entity(spark, name)


def with_columns_of(panel: DataFrame, other: DataFrame) -> DataFrame:
    """The panel with columns of another panel of the same layout, which take the place of its own of that name.

    Rows meet by entity, where both sides lie already, and their periods are compared inside it: an entity has few. Rows without a
    partner keep NULL.
    """
    names = [c for c in other.columns if c not in (E, P)]
    right = other.select(F.col(E).alias("_entity"), F.col(P).alias("_of"), *[F.col(c).alias(f"_o_{c}") for c in names])
    met = (F.col(E) == F.col("_entity")) & (F.col(P) - F.col("_of") == 0)
    joined = panel.drop(*names).join(right, met, "left")
    return joined.drop("_entity", "_of").withColumnsRenamed({f"_o_{c}": c for c in names})
