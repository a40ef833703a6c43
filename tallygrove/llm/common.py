"""Helpers that the training-data operators share: table reading, scratch tables in the shared folder, row numbering.

Scratch tables are written under the folder that the session names in ``spark.checkpoint.dir``, which every executor of a
cluster can read, so a lost executor costs a reread and never a result. Only where the session names none and runs in one
local process (tests) does a temporary folder serve; on a cluster a missing folder is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: ASCII white space, the word separators of every operator here.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_used: dict[str, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path below the session's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallygrove-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallygrove-{uuid.uuid4().hex}"


def save(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` as a scratch table and rereads it: the lineage ends there, and so does repeated work."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _used[path] = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(path: str) -> None:
    jvm, conf = _used.pop(path)
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


def drop(*saved: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more; each is what save() gave."""
    for df in saved:
        if df.scratch_path in _used:
            _delete(df.scratch_path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, saved; all scratch tables that it made on the way are deleted."""
    before = set(_used)
    out = save(make())
    for path in set(_used) - before - {out.scratch_path}:
        _delete(path)
    return out


def drop_scratch() -> None:
    """Deletes every scratch table of this process; results that still read one must have been consumed."""
    for path in list(_used):
        _delete(path)


atexit.register(drop_scratch)


def unique_docs(docs: DataFrame) -> DataFrame:
    """doc_id and text, each doc_id once: rows with a null id are left out, a null text is empty, and rows that repeat an id count as the one of the smallest text."""
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.groupBy("doc_id").count()
    return docs if ids.where("count > 1").isEmpty() else docs.groupBy("doc_id").agg(F.min("text").alias("text"))


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str, chunks: int = 64) -> DataFrame:
    """Adds ``out``, a gapless number from 0 within ``keys``.

    Rows are numbered within (keys, hash chunk of ``order``'s first) and moved up by the sizes of the chunks before, so that a
    key with a third of all rows is spread over ``chunks`` tasks, and rows of one first value follow each other. ``order`` must
    be unique within a key for a repeatable result.
    """
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(order[0]), F.lit(chunks)).cast("int"))
    sizes = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) - 1
    return df.withColumn("_within", within).join(sizes, [*keys, "_chunk"]).withColumn(out, (F.col("_before") + F.col("_within")).cast("long")).drop("_chunk", "_within", "_before")


def running_before(df: DataFrame, key: str, value: str, ties: list[str], out: str, chunks: int = 64) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``key`` that come first, the large ones first.

    The order is by the power of two that ``value`` reaches, then by a hash chunk of ``ties`` (unique within a key), then by
    value and ties, so a key with many rows is spread over ``chunks`` tasks for every power.
    """
    df = df.withColumn("_level", -F.floor(F.log2(value)).cast("int")).withColumn("_chunk", F.pmod(F.xxhash64(*ties), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(key).orderBy("_level", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(key, "_level", "_chunk").agg(F.sum(value).alias("_n"))
    sizes = sizes.select(key, "_level", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_level", "_chunk").orderBy(F.desc(value), *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sizes, [key, "_level", "_chunk"])
    return df.withColumn(out, F.col("_before") + F.col("_within")).drop("_level", "_chunk", "_before", "_within")


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column of ``taken`` is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    """A-Z only, as the contracts ask; ``lower`` would change other letters as well."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(column: Column) -> Column:
    """SHA-256 of the text's UTF-8, lowercase hex."""
    return F.sha2(column.cast("binary"), 256)


LONG, INT, STRING = T.LongType(), T.IntegerType(), T.StringType()
