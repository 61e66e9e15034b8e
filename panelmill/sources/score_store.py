"""Scores kept by (configuration, seed, period), cut and ensembled later without a fit.

A seed's scores replace only their own partitions. A line in the list of finished seeds follows the scores, so a run that was stopped
between the two repeats that seed and no other; readers see finished seeds only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import keys as K
from panelmill.operators.ledger import config_signature
from panelmill.sources.files import require_same_features

E, P = K.ENTITY, K.PERIOD
_DONE = "firma string, semilla long, columnas array<string>, filas long"


def key_of(config: Mapping[str, object]) -> str:
    """Signature of a configuration without its seeds and columns; the columns are compared by name and order."""
    return config_signature({k: v for k, v in config.items() if k not in ("columnas", "semillas")})


def finished(spark: SparkSession, folder: str, config: Mapping[str, object]) -> set[int]:
    """Seeds of the configuration whose scores are complete. Refuses if they come from other columns."""
    try:
        done = spark.read.schema(_DONE).parquet(f"{folder}/finished")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return set()
    rows = done.filter(F.col("firma") == key_of(config)).collect()  # one per seed
    for row in rows:
        require_same_features({"columnas": row.columnas}, config["columnas"])
    return {r.semilla for r in rows}


def save(scores: DataFrame, folder: str, config: Mapping[str, object], seed: int) -> None:
    """Scores (entity, period, score) of one seed; its earlier scores of these periods go."""
    spark, key = scores.sparkSession, key_of(config)
    finished(spark, folder, config)
    parts = ["firma", "semilla", P]
    kept = scores.select(E, "score", F.lit(key).alias("firma"), F.lit(seed).cast("long").alias("semilla"), P)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{folder}/scores")
    rows = _of(spark, folder, key).filter(F.col("semilla") == seed).count()
    line = spark.createDataFrame([(key, seed, list(config["columnas"]), rows)], _DONE)
    line.coalesce(1).write.mode("append").parquet(f"{folder}/finished")


def run(spark: SparkSession, folder: str, config: Mapping[str, object], seeds: Iterable[int], job: Callable[[int], DataFrame]) -> list[int]:
    """Score and keep the seeds that are not finished yet; returns those."""
    done = finished(spark, folder, config)
    missing = [s for s in seeds if s not in done]
    for seed in missing:
        save(job(seed), folder, config, seed)
    return missing


def _of(spark: SparkSession, folder: str, key: str) -> DataFrame:
    stored = spark.read.schema(f"{E} long, score double, firma string, semilla long, {P} int").parquet(f"{folder}/scores")
    return stored.filter(F.col("firma") == key)


def load(spark: SparkSession, folder: str, config: Mapping[str, object], periods: Sequence[int] | None = None) -> DataFrame:
    """(entity, period, semilla, score) of the finished seeds; configuration, seeds and periods prune the folders that are read."""
    stored = _of(spark, folder, key_of(config)).filter(F.col("semilla").isin(*finished(spark, folder, config)))
    return (stored if periods is None else stored.filter(F.col(P).isin(*periods))).select(E, P, "semilla", "score")
