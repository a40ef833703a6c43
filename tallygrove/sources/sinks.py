"""Sinks: parquet by cycle and snapshot, CSV, JSON lines, thresholds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame

from tallygrove.plans import features


def write_matrix(df: DataFrame, path: str) -> None:
    """One folder for each cycle and snapshot; only those in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle", "snapshot").parquet(path)


def write_checked(df: DataFrame, path: str, keys: tuple[str, ...] = ("cycle", "snapshot", "state", "district")) -> dict[str, int]:
    """As write_matrix(), but what is written takes its place only if it breaks no rule; ValueError with the counts if it does.

    One pass writes into a folder that readers pass over and counts violations and leaks on its way; then the folders of its
    cycles and snapshots are put in the place of the old ones. A bad matrix leaves these as they were.
    """
    rows, seen = features.observed(df, list(keys))
    staging, spark = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}", df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = folder(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        rows.write.partitionBy("cycle", "snapshot").parquet(staging)
        counts = seen.get
        if bad := {n: c for n, c in counts.items() if c and n != "rows"}:
            raise ValueError(f"the matrix breaks its rules: {bad}")
        for cycle in files.globStatus(folder(f"{staging}/cycle=*")) or []:
            files.mkdirs(folder(f"{path}/{cycle.getPath().getName()}"))
            for part in files.listStatus(cycle.getPath()):  # a folder a snapshot
                place = folder(f"{path}/{cycle.getPath().getName()}/{part.getPath().getName()}")
                files.delete(place, True)
                files.rename(part.getPath(), place)
        return counts
    finally:
        files.delete(folder(staging), True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_calibration(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of backtest.calibrate() below ``path``, replacing older ones: CSV, the summary JSON."""
    for name, df in tables.items():
        one = df.coalesce(1)  # a few rows
        if name == "summary":
            one.write.mode("overwrite").json(f"{path}/{name}")
        else:
            write_csv(one, f"{path}/{name}")


def write_thresholds(path: str, cuts: list[float], **about: object) -> None:
    if len(cuts) != 9 or sorted(cuts) != list(cuts):
        raise ValueError("nine ascending cuts are needed")
    with open(path, "w") as f:
        json.dump({"cutpoints": cuts} | about, f, indent=2, sort_keys=True)


def read_thresholds(path: str) -> list[float]:
    with open(path) as f:
        return json.load(f)["cutpoints"]
