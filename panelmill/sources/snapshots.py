"""Several tables published together: a version is one small file that names where each of its tables lies.

Tables of a version are written first, each into a folder of its own; the version's file is then put in place by one rename that fails if
another writer has taken that number. Readers see the version before or the version after, never a part. Tables that do not change are named
again, not copied. The rename must be atomic and must not replace a file, as on HDFS and on local disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Somebody else has published since the version a change was made from."""


def _hadoop(spark: SparkSession, path: str):
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    place = fs.Path(path)
    return fs, place, place.getFileSystem(conf), conf


def latest(spark: SparkSession, folder: str) -> int:
    """The number of the last published version; 0 where nothing is."""
    _, place, files, _ = _hadoop(spark, f"{folder}/versions")
    if not files.exists(place):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)


def contents(spark: SparkSession, folder: str, version: int) -> dict[str, str]:
    """Where each table of a version lies."""
    return json.loads(spark.read.text(f"{folder}/versions/{version:09d}.json").first().value) if version else {}


def read(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of one version, by default the last: they belong together."""
    tables = contents(spark, folder, latest(spark, folder) if version is None else version)
    return {name: spark.read.parquet(path) for name, path in tables.items()}


def publish(spark: SparkSession, folder: str, changed: Mapping[str, DataFrame], based_on: int) -> int:
    """Write the changed tables and publish them, with the others of `based_on`, as the next version. Returns its number.

    Raises `Conflict`, and publishes nothing, if `based_on` is not the last version any more. A failure at any place leaves the last
    version as it is; what was written until then is named by no version.
    """
    if latest(spark, folder) != based_on:
        raise Conflict(f"version {based_on} is not the last one")
    tables = contents(spark, folder, based_on)
    for name, frame in changed.items():
        path = f"{folder}/tables/{name}-{uuid.uuid4().hex}"
        frame.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        tables[name] = path
    _put(spark, folder, based_on + 1, json.dumps(tables, sort_keys=True))
    return based_on + 1


def _put(spark: SparkSession, folder: str, version: int, text: str) -> None:
    fs, staged, files, conf = _hadoop(spark, f"{folder}/versions/_staged-{uuid.uuid4().hex}")
    out = files.create(staged, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    keep = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)  # without the option to overwrite
    try:
        fs.FileContext.getFileContext(staged.toUri(), conf).rename(staged, fs.Path(f"{folder}/versions/{version:09d}.json"), keep)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            raise Conflict(f"version {version} was published by somebody else") from error
        raise
