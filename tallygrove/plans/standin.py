"""The engine's tables, stood in for by the driver's star schema, and the same as DuckDB common table expressions.

Line items are contributions of committees (orders) to candidates (customers); market segments are parties, nations states.
Money is whole cents, so sums are exact in any order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions import dates
from tallygrove.operators.results import margins

ELECTIONS = {1996: date(1996, 11, 5), 1998: date(1998, 11, 3), 2000: date(2000, 11, 7)}
FLAGSHIP_CUTOFF = dates.snapshot_date(1996, "T-60", ELECTIONS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cutoffs(spark: SparkSession) -> DataFrame:
    return dates.cutoffs(spark, ELECTIONS)


def cycle_of(day: str) -> F.Column:
    return (F.year(day) + F.year(day) % 2).cast("int")


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("l_linestatus") == "O", "indiv").otherwise("cmte")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cmte_id"), F.col("l_shipdate").alias("txn_date"), cycle_of("l_shipdate").alias("cycle"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), source.alias("source"), F.col("l_returnflag").alias("flag"))


def linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cmte_id"), F.col("o_custkey").alias("cand_id"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    party = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "D").when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), "R")
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cand_id"), F.col("c_name").alias("last_name"), party.alias("party_major"), F.col("c_nationkey").alias("state"), (F.col("c_custkey") % 10).cast("int").alias("district"),
        F.when(F.col("c_custkey") % 11 == 0, "S").otherwise("H").alias("office"), F.when(F.col("c_acctbal") > 7500, "I").when(F.col("c_acctbal") > 0, "C").alias("cand_ici"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("balance"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("cycle", F.year("o_orderdate").cast("int")).where(F.col("cycle").isin(*ELECTIONS))
    return rows.groupBy("cycle", F.col("o_custkey").alias("cand_id")).agg(F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100).alias("votes"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = votes(spark, sf_dir).join(candidates(spark, sf_dir).drop("balance", "office"), "cand_id")
    return margins(rows, ["cycle", "state", "district"])


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, district, cpvi, cook_rating (null for a third of the districts)."""
    rows = candidates(spark, sf_dir).groupBy("state", "district").agg(F.sum("balance").alias("_s"), F.count("*").alias("_n"))
    code = F.col("state") * 10 + F.col("district")
    return rows.select("state", "district", (F.floor(F.col("_s") / F.col("_n") / 40000).cast("int") - 11).alias("cpvi"), F.when(code % 3 != 0, 1 + ((code * 7) % 13) / 2).cast("double").alias("cook_rating"))


def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle, snapshot, cand_id, total_trans, trans_by_indiv, trans_by_cmte: one scan, all snapshots."""
    from tallygrove.operators import money as m

    parts = {"i": F.col("source") == "indiv", "c": F.col("source") == "cmte"}
    sums = m.as_of_sums(contributions(spark, sf_dir), cutoffs(spark), linkage(spark, sf_dir), parts)
    return m.in_whole(sums, ["cycle", "snapshot", "cand_id"], {"total_trans": F.col("i") + F.col("c"), "trans_by_indiv": F.col("i"), "trans_by_cmte": F.col("c")})


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One D row an order, with a rating, an index, incumbency, money and a margin that leans with the rating: what a model is fitted on.

    An order's party would be that of a district; here every order is a district of its own.
    """
    k, cents = F.col("o_custkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    rating = 1 + ((k * 7) % 13) / 2
    return read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, 2000).otherwise(1998).alias("cycle"), (k % 25).cast("int").alias("state"), F.col("o_orderkey").alias("district"), F.lit("D").alias("party_major"), F.lit("N").alias("last_name"),
        F.when(k % 5 != 0, rating).cast("double").alias("cook_rating"), (k % 21 - 10).cast("int").alias("cpvi"), (F.col("o_orderkey") % 2).cast("int").alias("incumbent"),
        ((rating - 4) * 0.04 + (cents % 2001 - 1000) / 5000.0).cast("double").alias("margin_pct"), ((rating - 4) * 0.04 + (cents % 2001 - 1000) / 5000.0 > 0).alias("winner"), F.floor(cents / 100).alias("total_trans"),
        F.log1p((F.col("o_orderkey") * 37 % 100_000).cast("double")).alias("opp_raised_log"), F.log1p((k * 91 % 5000).cast("double")).alias("ie_against_log"), (40_000 + k % 30_000).cast("double").alias("acs_median_income"),
    )


SQL = {
    "races": """races AS (SELECT CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2000 ELSE 1998 END AS INT) AS cycle, CAST(o_custkey % 25 AS INT) AS state, o_orderkey AS district, CASE WHEN o_custkey % 5 <> 0 THEN rating END AS cook_rating,
  CAST(o_custkey % 21 - 10 AS INT) AS cpvi, CAST(o_orderkey % 2 AS INT) AS incumbent, (rating - 4) * 0.04::DOUBLE + (cents % 2001 - 1000) / 5000.0::DOUBLE AS margin_pct, CAST(cents // 100 AS BIGINT) AS total_trans,
  ln(1 + CAST(o_orderkey * 37 % 100000 AS DOUBLE)) AS opp_raised_log, ln(1 + CAST(o_custkey * 91 % 5000 AS DOUBLE)) AS ie_against_log, CAST(40000 + o_custkey % 30000 AS DOUBLE) AS acs_median_income
  FROM (SELECT *, 1 + ((o_custkey * 7) % 13) / 2.0::DOUBLE AS rating, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders))""",
    "cutoffs": """cutoffs AS (SELECT cycle, snapshot, election, CAST(election - days * INTERVAL 1 DAY AS DATE) AS cutoff FROM
  (VALUES (1996, DATE '1996-11-05'), (1998, DATE '1998-11-03'), (2000, DATE '2000-11-07')) e(cycle, election), (VALUES ('T-110', 110), ('T-60', 60), ('T-20', 20)) s(snapshot, days))""",
    "contributions": """contributions AS (SELECT l_orderkey AS cmte_id, l_shipdate AS txn_date, CAST(year(l_shipdate) + year(l_shipdate) % 2 AS INT) AS cycle,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CASE WHEN l_linestatus = 'O' THEN 'indiv' ELSE 'cmte' END AS source, l_returnflag AS flag FROM lineitem)""",
    "candidates": """candidates AS (SELECT c_custkey AS cand_id, c_name AS last_name, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'D' WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'R' END AS party_major,
  c_nationkey AS state, CAST(c_custkey % 10 AS INT) AS district, CASE WHEN c_custkey % 11 = 0 THEN 'S' ELSE 'H' END AS office,
  CASE WHEN c_acctbal > 7500 THEN 'I' WHEN c_acctbal > 0 THEN 'C' END AS cand_ici, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer)""",
    "votes": """votes AS (SELECT CAST(year(o_orderdate) AS INT) AS cycle, o_custkey AS cand_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 100 AS BIGINT) AS votes
  FROM orders WHERE year(o_orderdate) IN (1996, 1998, 2000) GROUP BY ALL)""",
    "results": """results AS (SELECT *, (top_d - top_r) / CAST(nullif(top_d + top_r, 0) AS DOUBLE) AS margin, votes = max(votes) OVER w AS winner, CAST(sum(votes) OVER w AS BIGINT) AS total_votes,
  votes / CAST(nullif(sum(votes) OVER w, 0) AS DOUBLE) AS vote_share FROM (
    SELECT cand_id, v.cycle, votes, last_name, party_major, state, district, cand_ici,
      coalesce(max(votes) FILTER (party_major = 'D') OVER w, 0) AS top_d, coalesce(max(votes) FILTER (party_major = 'R') OVER w, 0) AS top_r
    FROM votes v JOIN candidates USING (cand_id) WINDOW w AS (PARTITION BY v.cycle, state, district)) WINDOW w AS (PARTITION BY cycle, state, district))""",
    "ratings": """ratings AS (SELECT state, district, CAST(floor(sum(balance) / CAST(count(*) AS DOUBLE) / 40000) AS INT) - 11 AS cpvi,
  CASE WHEN (state * 10 + district) % 3 <> 0 THEN 1 + (((state * 10 + district) * 7) % 13) / 2.0::DOUBLE END AS cook_rating FROM candidates GROUP BY state, district)""",
    "money": """money AS (SELECT cycle, snapshot, cand_id, CAST((i + c) // 100 AS BIGINT) AS total_trans, CAST(i // 100 AS BIGINT) AS trans_by_indiv, CAST(c // 100 AS BIGINT) AS trans_by_cmte FROM (
  SELECT t.cycle, snapshot, o_custkey AS cand_id, coalesce(sum(cents) FILTER (source = 'indiv'), 0) AS i, coalesce(sum(cents) FILTER (source = 'cmte'), 0) AS c
  FROM contributions t JOIN cutoffs k ON t.cycle = k.cycle AND txn_date <= cutoff JOIN orders ON o_orderkey = cmte_id GROUP BY ALL))""",
    "topped": """topped AS (SELECT * FROM results WHERE party_major IN ('D', 'R') QUALIFY row_number() OVER (PARTITION BY cycle, state, district, party_major ORDER BY votes DESC, last_name, cand_id) = 1)""",
    "contested": """contested AS (SELECT t.* FROM topped t WHERE margin BETWEEN -0.999999 AND 0.999999 AND (SELECT count(DISTINCT party_major) FROM topped u WHERE u.cycle = t.cycle AND u.state = t.state AND u.district = t.district AND u.margin BETWEEN -0.999999 AND 0.999999) = 2)""",
}
_NEEDS = {"results": ["votes", "candidates"], "ratings": ["candidates"], "money": ["contributions", "cutoffs"], "topped": ["results"], "contested": ["topped"]}


def ctes(*names: str) -> str:
    """``WITH`` and the named tables with all that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n"
