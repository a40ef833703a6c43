"""The feature matrix, all cycles and snapshots in one plan: cycle and snapshot are columns, never loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallygrove.functions import dates
from tallygrove.functions import numeric as nx
from tallygrove.operators.results import contested, top_candidate, top_of_party

DISTRICT = ("state", "district")
#: Cycles whose ratings may come from after the election.
BACKFILLED = (2014, 2016, 2018)
DEMOGRAPHICS = ("median_age", "race_white", "race_black", "race_asian", "edu_bachelors", "edu_grad_degree", "median_income", "below_100pct_fpl")
SLOP_DAYS = 30


def derive(df: DataFrame, keys: list[str]) -> DataFrame:
    """Logs, the opponent's money, own share of the pair, incumbency, margin: one projection over one window."""
    w = Window.partitionBy(*keys)
    own = nx.number(F.col("total_trans"), "bigint")
    side = {p: F.coalesce(F.sum(F.when(F.col("party_major") == p, F.col("total_trans"))).over(w), F.lit(0)) for p in "DR"}
    df = df.withColumn("total_trans", own).withColumn("opp_raised", F.when(F.col("party_major") == "D", side["R"]).otherwise(side["D"]))
    both = F.col("total_trans") + F.col("opp_raised")
    spending = {c: nx.number(F.col(c), "bigint") if c in df.columns else F.lit(0) for c in ("ie_for_total", "ie_against_total")}
    df = df.withColumns(spending)
    return df.withColumns({
        "margin_pct": F.col("margin"),
        "incumbent": F.coalesce((F.upper("cand_ici") == "I").cast("int"), F.lit(0)),  # a missing code is no incumbent
        "self_raised_log": F.log1p("total_trans"),
        "opp_raised_log": F.log1p("opp_raised"),
        "self_raised_pct": F.when(both > 0, F.col("total_trans") / both).otherwise(0.5),
        "ie_for_log": F.log1p("ie_for_total"),
        "ie_against_log": F.log1p("ie_against_total"),
    })


def build(results: DataFrame, ratings: DataFrame, index: DataFrame, demographics: DataFrame, money: DataFrame, spending: DataFrame | None) -> DataFrame:
    """The matrix at the grain (cycle, snapshot, state, district, party).

    results: cycle, state, district, cand_id, last_name, party_major, votes, margin, winner. ratings, index: (cycle, snapshot,)
    district columns; money: (cycle, snapshot, cand_id) totals and cand_ici; spending: (cycle, snapshot, cand_id) totals, None
    where money holds them.
    Ratings, indexes and demographics are a row for each district, so Spark broadcasts them where it may.
    """
    keys = ["cycle", "snapshot", *DISTRICT]
    base = top_candidate(results.where(F.col("party_major").isin("D", "R")), ["cycle", *DISTRICT])
    rows = base.join(ratings, ["cycle", *DISTRICT], "left")
    rows = rows.join(index.withColumnRenamed("cpvi", "_fallback"), ["cycle", *DISTRICT], "left").withColumn("cpvi", F.coalesce("cpvi", "_fallback")).drop("_fallback")
    own = [c for c in DEMOGRAPHICS if c in demographics.columns]
    rows = rows.join(demographics.select(*DISTRICT, *(F.col(c).alias(f"acs_{c}") for c in own)), list(DISTRICT), "left")
    rows = rows.join(money, ["cycle", "cand_id"], "left")
    rows = rows if spending is None else rows.join(spending, ["cycle", "snapshot", "cand_id"], "left")
    # Of several records of one name the one with most money, which depends on the snapshot.
    rows = top_of_party(rows.where("snapshot is not null and cand_id is not null"), keys, "total_trans", ("cand_id",))
    return derive(contested(rows, keys), keys)


def audited(df: DataFrame, revision: str | None = None, backfilled: tuple[int, ...] = BACKFILLED) -> DataFrame:
    """Audit columns of districts that no page rates: those of the page that was looked at."""
    leaky = F.col("cycle").isin(*backfilled)
    return df.withColumns({"ratings_source": F.coalesce("ratings_source", F.lit("wikipedia")), "leaky_ratings": F.coalesce("leaky_ratings", leaky), "ratings_revision_ts": F.coalesce("ratings_revision_ts", F.lit(revision).cast("string"))})


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """check, n: margins out of range, and districts without exactly one row of each side."""
    margin = df.agg(F.lit("margin_range").alias("check"), F.count_if(~F.coalesce(F.col("margin_pct").between(-0.999999, 0.999999), F.lit(False))).alias("n"))
    pairs = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.size(F.collect_set("party_major")).alias("_s")).agg(F.lit("district_pairs").alias("check"), F.count_if((F.col("_n") != 2) | (F.col("_s") != 2)).alias("n"))
    return margin.unionByName(pairs)


def broken_rule(columns: list[str], backfilled: tuple[int, ...] = BACKFILLED, slop: int = SLOP_DAYS) -> Column:
    """The rule of its ratings' source that a row breaks, or null, from cycle, snapshot_date, ratings_source, leaky_ratings and ratings_day or ratings_revision_ts."""
    day = F.col("ratings_day") if "ratings_day" in columns else dates.from_stamp(F.col("ratings_revision_ts"))
    wiki_back = (F.col("ratings_source") == "wikipedia") & F.col("cycle").isin(*backfilled)
    archive = F.col("ratings_source") == "wayback_cook"
    return (
        F.when(wiki_back, F.when(~F.col("leaky_ratings"), "backfilled_not_flagged"))
        .when(archive, F.when(F.col("leaky_ratings"), "archive_flagged").when(day.isNull(), "no_day").when(day > F.date_add("snapshot_date", slop), "archive_too_late"))
        .when(F.col("leaky_ratings"), "clean_flagged")
        .when(day.isNull() | (day > F.col("snapshot_date")), "after_snapshot")
    )


def leaks(df: DataFrame, backfilled: tuple[int, ...] = BACKFILLED, slop: int = SLOP_DAYS) -> DataFrame:
    """Rows that break their source's rule, and the rule."""
    return df.withColumn("rule", broken_rule(df.columns, backfilled, slop)).where("rule is not null")


def observed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Observation]:
    """``df`` and the counts of violations and, where there are audit columns, of leaks, taken by the pass that writes it.

    A task that runs twice may count a row twice, so a count is good for being 0 or not.
    """
    side = Window.partitionBy(*keys)
    pair = (F.count("*").over(side) == 2) & (F.size(F.collect_set("party_major").over(side)) == 2)
    rows = df.withColumn("_pair", pair)
    counts = {"rows": F.count("*"), "margin_range": F.count_if(~F.coalesce(F.col("margin_pct").between(-0.999999, 0.999999), F.lit(False))), "district_pairs": F.count_if(~F.col("_pair"))}
    if {"ratings_source", "leaky_ratings", "snapshot_date"} <= set(df.columns):
        counts["leaks"] = F.count_if(broken_rule(df.columns).isNotNull())
    seen = Observation()
    return rows.observe(seen, *(c.alias(n) for n, c in counts.items())).drop("_pair"), seen
