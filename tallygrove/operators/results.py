"""Election results: general-election rows, margins, winners, shares, and the chamber."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions import text as fx

def general(rows: DataFrame, year: int, office: str = "US HOUSE") -> DataFrame:
    """The general election's rows of a year, special elections left out; ValueError if there are none."""
    out = rows.where((F.col("year").try_cast("int") == year) & (F.upper("office") == office) & (F.upper("stage") == "GEN") & (F.upper(F.col("special").cast("string")) != "TRUE"))
    if out.isEmpty():
        raise ValueError(f"no general-election rows for {year}")
    return out


def margins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, party_major, votes. Adds margin (top D against top R over both, null without votes), winner and vote_share."""
    w = Window.partitionBy(*keys)
    d, r = (F.coalesce(F.max(F.when(F.col("party_major") == p, F.col("votes"))).over(w), F.lit(0)) for p in "DR")
    total = F.sum("votes").over(w)
    return rows.withColumns({
        "margin": F.try_divide(d - r, d + r).cast("double"),
        "winner": F.col("votes") == F.max("votes").over(w),
        "total_votes": total,
        "vote_share": F.try_divide(F.col("votes"), total).cast("double"),
    })


def top_candidate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the candidate with most votes of each key and party, of equal ones the first name: one for each record of that name."""
    order = [F.desc(F.coalesce("votes", F.lit(0))), F.asc_nulls_last("last_name")]
    return rows.withColumn("_rn", F.rank().over(Window.partitionBy(*keys, "party_major").orderBy(*order))).where("_rn = 1").drop("_rn")


def top_of_party(rows: DataFrame, keys: list[str], by: str = "votes", ties: tuple[str, ...] = ("last_name", "cand_id")) -> DataFrame:
    """The row with most of ``by`` of each key and party, a missing one counted 0; equal ones by ``ties``."""
    order = [F.desc(F.coalesce(by, F.lit(0))), *(F.asc_nulls_last(t) for t in ties if t in rows.columns)]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "party_major").orderBy(*order))).where("_rn = 1").drop("_rn")


def contested(rows: DataFrame, keys: list[str], need_record: bool = True) -> DataFrame:
    """Major-party rows with a record and a contested margin, of the districts that then have exactly one D and one R side."""
    kept = rows.where(F.col("party_major").isin("D", "R") & F.col("margin").between(-0.999999, 0.999999))
    kept = kept.where("cand_id is not null") if need_record else kept
    both = F.size(F.collect_set("party_major").over(Window.partitionBy(*keys)))
    return kept.withColumn("_sides", both).where("_sides = 2").drop("_sides")


def chamber(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, party_major (D, R or OTHER), votes, cand_id. status, winner_party and the D share of all D and R votes."""
    party = F.coalesce("party_major", F.lit("OTHER"))
    has = {p: F.max(F.when(party == p, 1).otherwise(0)) for p in "DR"}
    votes = {p: F.coalesce(F.sum(F.when(party == p, F.col("votes"))), F.lit(0)) for p in "DR"}
    out = rows.groupBy(*keys).agg(has["D"].alias("_d"), has["R"].alias("_r"), F.max_by(party, F.struct("votes", -F.col("cand_id"))).alias("winner_party"), votes["D"].alias("_vd"), votes["R"].alias("_vr"))
    status = F.when((F.col("_d") == 1) & (F.col("_r") == 1), "contested").when(F.col("_d") == 1, "d_lock").when(F.col("_r") == 1, "r_lock").otherwise("other_lock")
    return out.select(*keys, status.alias("status"), "winner_party", F.try_divide(F.col("_vd"), F.col("_vd") + F.col("_vr")).cast("double").alias("d_two_party_share"))


def chamber_counts(view: DataFrame) -> DataFrame:
    return view.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("winner_party") == "D").alias("n_d"))


def counterfactual(rows: DataFrame, k: int, within: float = 0.05) -> DataFrame:
    """D rows of races that R won: whether among the ``k`` closest, and whether lost by less than ``within``."""
    lost = rows.where((F.col("party_major") == "D") & (F.col("margin") < 0))
    last = lost.orderBy(F.abs("margin"), "state", "district").limit(k).agg(F.max(F.struct(F.abs("margin").alias("m"), "state", "district")).alias("_last"))  # one row
    own = F.struct(F.abs("margin").alias("m"), "state", "district")
    return lost.crossJoin(F.broadcast(last)).withColumns({"pivotal": own <= F.col("_last"), "winnable": F.abs("margin") < within}).drop("_last")


def parties(column: str) -> F.Column:
    """Party of a results file, where fewer labels count than in candidate files."""
    return fx.party_major(F.col(column), fx.RESULT_DEMOCRATS, fx.RESULT_REPUBLICANS)
