"""Session settings: adaptive execution, ANSI errors, UTC."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_saved: dict[str, SparkSession] = {}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tallygrove", **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` adds settings, dots written as double underscores."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the folder that all executors share; a temporary one where the session is one local process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallygrove-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df``, written below scratch() and read again, for what a plan would otherwise work out several times.

    The files go at the end of the process, or with dropped() once nothing reads them any more.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    _saved[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what saved() wrote for these."""
    for path in {t.scratch_path for t in tables} & set(_saved):
        _delete(path)


def _delete(path: str) -> None:
    spark = _saved.pop(path)
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


def drop_all() -> None:
    """Deletes every scratch table of this process."""
    for path in list(_saved):
        _delete(path)


atexit.register(drop_all)
