"""Files in and out: panels, score tables, guarded selection lists, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions import keys as K
from panelmill.session import ensure_checkpoint_dir

E, P = K.ENTITY, K.PERIOD


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, where every executor can read and write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (also .csv.gz) with a header: with a schema, or with types inferred from every row.

    The entity key arrives as a double in some files and is cast to long at once.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.options(inferSchema=True, samplingRatio=1.0)
    return with_long_entity(reader.csv(path))


def read_text_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose quoted fields may hold line breaks and quotes; white space is kept."""
    return (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="\\N", lineSep="\n", maxCharsPerColumn=-1)
        .csv(path)
    )


def write_text_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(
        header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        emptyValue="", nullValue="\\N", lineSep="\n",
    ).csv(path)


def with_long_entity(df: DataFrame) -> DataFrame:
    return df.withColumn(E, F.col(E).cast("long")) if E in df.columns else df


def read_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               periods: Sequence[int] | None = None) -> DataFrame:
    """Parquet panel; columns and periods are pushed into the scan, periods prune folders."""
    df = spark.read.parquet(path)
    if periods is not None:
        df = df.filter(F.col(P).isin(*periods))
    if columns is not None:
        df = df.select(E, P, *[c for c in columns if c not in (E, P)])
    return with_long_entity(df)


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_panel(df: DataFrame, path: str, force: bool = False) -> None:
    """ZSTD parquet in one folder per period. An existing panel stays unless `force`."""
    df.write.mode(_mode(force)).option("compression", "zstd").partitionBy(P).parquet(path)


def write_csv(df: DataFrame, path: str, force: bool = False, compression: str = "none") -> None:
    df.write.mode(_mode(force)).option("header", True).option("compression", compression).csv(path)


def write_scores(scores: DataFrame, folder: str, seed: int, period: int, force: bool = False) -> None:
    """One score table per seed, the seed in its name."""
    scores.select(E, "score").write.mode(_mode(force)).parquet(f"{folder}/scores_{period}_s{seed}.parquet")


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All seeds' score tables in one read; the seed comes from the file name."""
    seed = F.regexp_extract(F.input_file_name(), r"scores_\d+_s(\d+)\.parquet", 1).cast("long")
    period = F.regexp_extract(F.input_file_name(), r"scores_(\d+)_s\d+\.parquet", 1).cast("int")
    return spark.read.parquet(f"{folder}/scores_*_s*.parquet").select(
        E, period.alias(P), seed.alias("semilla"), "score"
    )


def check_selection(ids: DataFrame, valid: DataFrame | None = None, lowest: int = K.MIN_SELECTED,
                    highest: int = K.MAX_SELECTED) -> int:
    """Size within bounds, no repeated entity, none outside the valid month. Returns the size."""
    keyed = ids.select(F.col(E).cast("long").alias(E))
    row = keyed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(E).alias("d")).first()
    if not lowest <= row.n <= highest:
        raise ValueError(f"{row.n} selected, outside [{lowest}, {highest}]")
    if row.d != row.n:
        raise ValueError(f"{row.n - row.d} repeated entities")
    if valid is not None:
        outside = keyed.join(valid.select(F.col(E).cast("long").alias(E)).distinct(), E, "left_anti").count()
        if outside:
            raise ValueError(f"{outside} entities are not in the month")
    return row.n


def export_selection(ids: DataFrame, path: str, valid: DataFrame | None = None, lowest: int = K.MIN_SELECTED,
                     highest: int = K.MAX_SELECTED, force: bool = False) -> int:
    """Write a checked list of entities, one per line, ascending, without header; read back and compare.

    The list is at most `highest` rows, so it is sorted into a single file.
    """
    n = check_selection(ids, valid, lowest, highest)
    lines = ids.select(F.col(E).cast("long").alias(E))
    lines.orderBy(E).coalesce(1).select(F.col(E).cast("string").alias("value")).write.mode(_mode(force)).text(path)
    spark = ids.sparkSession
    back = spark.read.text(path)
    if back.filter(~F.col("value").rlike(r"^-?\d+$")).count():
        raise AssertionError(f"{path}: lines that are not plain integers")
    again = read_selection(spark, path)
    if again.exceptAll(lines).count() or lines.exceptAll(again).count():
        raise AssertionError(f"{path}: what was read back differs from what was written")
    return n


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").cast("long").alias(E))


def export_ordered(df: DataFrame, path: str, by: Sequence[str], force: bool = False) -> None:
    """A CSV export in key order, for stable diffs: range-sorted, so its part files are in order too."""
    write_text_csv(df.orderBy(*by), path, _mode(force))


def write_manifest(spark: SparkSession, path: str, values: Mapping[str, object], force: bool = False) -> None:
    """What a run used and found, as one JSON line."""
    spark.createDataFrame([(json.dumps(dict(values), sort_keys=True),)], "value string").coalesce(1).write.mode(
        _mode(force)
    ).text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def require_same_features(manifest: Mapping[str, object], wanted: Sequence[str]) -> None:
    """A stored model or score table must come from exactly the requested columns, in order."""
    if list(manifest.get("columnas", [])) != list(wanted):
        raise ValueError("stored features differ from the requested ones; fit again")
