"""Staged sources: JSON and JSON lines, survey responses, parquet by cycle and snapshot, and files fetched beforehand."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import urllib.request
import zipfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions import dates

# Survey variables and their names.
ACS = {
    "B01003_001E": "total_pop", "B01002_001E": "median_age", "B02001_002E": "race_white", "B02001_003E": "race_black", "B02001_004E": "race_amer_ind", "B02001_005E": "race_asian",
    "B02001_006E": "race_pacific", "B02001_008E": "race_two_plus", "B05001_006E": "not_us_citizen", "B05001_005E": "us_citizen_naturalized", "B05002_003E": "born_in_state", "B05012_001E": "born_in_us",
    "B06007_001E": "language_universe", "B06007_002E": "speaks_only_english", "B06007_003E": "speaks_spanish", "B06009_002E": "edu_less_than_hs", "B06009_003E": "edu_hs_grad", "B06009_004E": "edu_some_college",
    "B06009_011E": "edu_bachelors", "B06009_012E": "edu_grad_degree", "B06010_001E": "income_universe", "B06010_002E": "income_none", "B06011_001E": "median_income", "B06012_001E": "poverty_universe",
    "B06012_002E": "below_100pct_fpl", "B06012_003E": "fpl_100_to_149", "B17001A_003E": "poverty_white_male_below", "B17001A_017E": "poverty_white_female_below", "B17001A_032E": "poverty_white_male_above", "B17001A_046E": "poverty_white_female_above",
    "B17001B_003E": "poverty_black_male_below", "B17001B_017E": "poverty_black_female_below", "B17001B_032E": "poverty_black_male_above", "B17001B_046E": "poverty_black_female_above",
}


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def acs(spark: SparkSession, paths: list[str], cycle: int, states: dict[str, str]) -> DataFrame:
    """Staged survey responses (a JSON array of rows, the first the header) as one typed table, read by Spark. states: FIPS code to postal code."""
    page = spark.read.text(paths, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("_rows"))
    rows = page.select(F.get("_rows", F.lit(0)).alias("_names"), F.posexplode("_rows").alias("_at", "_row")).where("_at > 0")
    cell = {n: F.get("_row", (F.array_position("_names", n) - 1).cast("int")) for n in ["NAME", *ACS, "state", "congressional district"]}
    cell = {n: F.when(F.array_contains("_names", n), c) for n, c in cell.items()}
    code = F.create_map(*(F.lit(x) for kv in states.items() for x in kv)) if states else F.create_map().cast("map<string,string>")
    out = [cell["NAME"].alias("NAME"), *(cell[k].try_cast("double").alias(v) for k, v in ACS.items()), cell["state"].alias("state_fips"), F.try_element_at(code, cell["state"]).alias("state_abbr")]
    return rows.select(*out, cell["congressional district"].try_cast("int").alias("district"), F.lit(cycle).alias("cycle"))


def latest_revision(log: DataFrame, cutoffs: DataFrame, key: str, at: str, revision: str) -> DataFrame:
    """cutoffs: ``key``, cutoff and may_fill, whether the key's cycle is one that is filled back.

    The last revision up to the cutoff's end of day. Where there is none, a key that may be filled back gets its first revision
    ever, flagged ``backfilled``; any other one gets null, since what comes after the cutoff was not known then.
    """
    inside = F.col(at) < F.date_add("cutoff", 1)
    found = cutoffs.join(log, key, "left").groupBy(key, "cutoff", "may_fill").agg(F.max_by(revision, F.when(inside, F.struct(at, revision))).alias("_last"), F.min_by(revision, F.struct(at, revision)).alias("_first"))
    filled = F.col("_last").isNull() & F.col("_first").isNotNull() & F.coalesce("may_fill", F.lit(False))
    return found.select(key, "cutoff", F.coalesce("_last", F.when(filled, F.col("_first"))).alias(revision), filled.alias("backfilled"))


def days_off(stamp: str, day: str) -> F.Column:
    """Days between a stamp's day and another day; null if the stamp is unreadable."""
    return F.abs(F.date_diff(dates.from_stamp(F.col(stamp)), F.col(day)))


def latest_stamp(index: DataFrame, snapshot: str, since: str) -> DataFrame:
    """index: ts (``YYYYMMDDHHMMSS``). The last one whose day is in ``since`` to ``snapshot`` (``YYYYMMDD``, inclusive)."""
    day = F.substring("ts", 1, 8)
    return index.where((day <= snapshot) & (day >= since)).agg(F.max("ts").alias("ts"))


def processed(spark: SparkSession, path: str, cycle: int | None = None, snapshot: str | None = None) -> DataFrame:
    """The feature matrix, partitioned by cycle and snapshot; FileNotFoundError with a hint where there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path}: build the feature matrix first") from e
    if cycle is not None:
        df = df.where(F.col("cycle") == cycle)
    return df if snapshot is None else df.where(F.col("snapshot") == snapshot)


def retry(call: Callable[[], object], tries: int = 3, wait: float = 1.0, errors: tuple = (OSError, ValueError)) -> object:
    """``call()``, up to ``tries`` times, with doubled waits between."""
    for k in range(tries):
        try:
            return call()
        except errors:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def download(url: str, dest: str, digest: str | None = None, timeout: float = 60, tries: int = 3, wait: float = 1.0) -> str:
    """Fetches a file unless it is there (and right): into a part file, which then takes its name at once."""
    if os.path.exists(dest) and (digest is None or sha256(dest) == digest):
        return dest
    os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
    part = dest + ".part"

    def fetch() -> None:
        with urllib.request.urlopen(url, timeout=timeout) as r, open(part, "wb") as f:
            shutil.copyfileobj(r, f, 1 << 20)
        if digest is not None and sha256(part) != digest:
            os.remove(part)
            raise ValueError(f"{url}: wrong checksum")
        os.replace(part, dest)

    retry(fetch, tries, wait)
    return dest


def unzip(archive: str, members: dict[str, str], into: str) -> list[str]:
    """members: name in the archive to file name. Extracts those that are not there yet."""
    os.makedirs(into, exist_ok=True)
    out = []
    with zipfile.ZipFile(archive) as z:
        for member, name in members.items():
            path = os.path.join(into, name)
            if not os.path.exists(path):
                with z.open(member) as src, open(path + ".part", "wb") as dst:
                    shutil.copyfileobj(src, dst, 1 << 20)
                os.replace(path + ".part", path)
            out.append(path)
    return out
