"""Extension (the pipeline itself is batch only): running totals of contributions by window, as a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(rows: DataFrame, at: str, keys: list[str], amount: str, width: str, late: str | None = None) -> DataFrame:
    """window, keys, n and total of ``amount``; a stream drops rows later than ``late`` behind its watermark."""
    if late:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


def stream(spark: SparkSession, path: str, schema: str, at: str, keys: list[str], amount: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """The same over files that arrive in ``path``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return windowed(rows, at, keys, amount, width, late)
