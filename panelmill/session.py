"""Session helpers: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its counted rows take at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: Rows that one task of a keyed shuffle is to sort or hash, where they are dealt by count.
TASK_ROWS = 1 << 20


def local_session(app: str = "panelmill", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one up only on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelmill-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so later readers all see the same rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet under the session's checkpoint folder and read again.

    For wide intermediate tables: compressed columns take a fraction of what a checkpoint does. The files go with
    the checkpoint folder.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each action in here drops the files of its shuffles when it ends, not whenever the driver happens to collect garbage.

    For steps whose results are staged or checkpointed at once: a frame made in here shuffles again for each action.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def broadcast_if_small(df: DataFrame, row_bytes: int | None = None) -> DataFrame:
    """Materialise an aggregate and hint a broadcast if its rows, of `row_bytes` each, fit the bound.

    Above the bound the frame comes back without a hint and joins by shuffle, with the same result. Without
    `row_bytes` a row counts 64 bytes a column.
    """
    small = checkpoint(df)
    return F.broadcast(small) if small.count() * (row_bytes or 64 * len(df.columns)) <= BROADCAST_BYTES else small


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks to deal so many rows over; None while the session's own cores, with TASK_ROWS each, are enough."""
    wanted = -(-rows // TASK_ROWS)
    if wanted <= spark.sparkContext.defaultParallelism:
        return None
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """The rows dealt by key over a number of tasks that grows with them; joins and groups by the keys go on from there.

    Adaptive execution joins partitions up to a size in compressed bytes, which for rows of a few keys is many millions of rows to sort at once.
    """
    return df if tasks is None else df.repartition(tasks, *keys)
