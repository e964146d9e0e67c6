"""Folders that the driver and all executors share, and small helpers of the operators.

A step whose result is read more than once is written as Parquet below `spark.checkpoint.dir`, so a lost executor
costs the unfinished tasks only. A folder of our own is used only where the session names none, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    if not (top := conf.get("spark.checkpoint.dir", None)):
        if not (got := spark.sparkContext.getCheckpointDir()):
            if not conf.get("spark.master", "local").startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
            got = spark.sparkContext.getCheckpointDir()
        top = got
    return top.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; it goes by spent(), by drop() or when the application ends.

    df itself is run once only, so the shuffle files of the run go with its end.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.factloom_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read any more."""
    for t in tables:
        at = (t.sparkSession, t.factloom_path)
        if at in _made:
            _made.remove(at)
            _remove(*at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def drop() -> None:
    """Remove the tables that this process has written."""
    while _made:
        try:
            _remove(*_made.pop())
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with the cluster's own clean-up
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most `rows` rows, the first in the order of a hash of the keys: the same rows wherever they stand."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(rows)
