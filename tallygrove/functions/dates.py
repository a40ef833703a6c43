"""Dates: snapshot cutoffs and lenient parsers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days of general elections, and snapshots as days before.
ELECTIONS = {2014: date(2014, 11, 4), 2016: date(2016, 11, 8), 2022: date(2022, 11, 8), 2024: date(2024, 11, 5)}
SNAPSHOTS = {"T-110": 110, "T-60": 60, "T-20": 20}


def snapshot_date(cycle: int, snapshot: str, elections: dict[int, date] = ELECTIONS) -> date:
    return elections[cycle] - timedelta(days=SNAPSHOTS[snapshot])


def cutoffs(spark: SparkSession, elections: dict[int, date] = ELECTIONS) -> DataFrame:
    """cycle, snapshot, election, cutoff: a row for each pair, so a few dozen at most."""
    rows = [(c, s, day) for c, day in elections.items() for s in SNAPSHOTS]
    days = F.create_map(*(F.lit(x) for pair in SNAPSHOTS.items() for x in pair))
    return spark.createDataFrame(rows, "cycle int, snapshot string, election date").withColumn("cutoff", F.date_sub("election", F.element_at(days, F.col("snapshot"))))


def from_mmddyyyy(text: Column) -> Column:
    """``09062024`` (a lost leading zero is put back) to a date, else null."""
    return F.try_to_timestamp(F.when(F.trim(text).rlike(r"^\d{7,8}$"), F.lpad(F.trim(text), 8, "0")), F.lit("MMddyyyy")).cast("date")


def from_dd_mon_yy(text: Column) -> Column:
    """``06-SEP-24`` to a date of this century, else null."""
    return F.try_to_timestamp(F.initcap(F.lower(F.trim(text))), F.lit("dd-MMM-yy")).cast("date")


def from_stamp(text: Column) -> Column:
    """The day of ``YYYYMMDDHHMMSS``, or of an ISO time, else null."""
    return F.coalesce(F.try_to_timestamp(F.substring(F.trim(text), 1, 8), F.lit("yyyyMMdd")).cast("date"), text.try_cast("timestamp").cast("date"))
