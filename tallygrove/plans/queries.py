"""The driver's queries for the engine's own operators, relational part: each a DataFrame plan and the DuckDB SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.functions import dates
from tallygrove.functions import numeric as nx
from tallygrove.functions import text as fx
from tallygrove.operators import allocate as al
from tallygrove.operators import match as mt
from tallygrove.operators import money as mo
from tallygrove.operators import results as rs
from tallygrove.operators.selection import percentiles
from tallygrove.plans import features as ft
from tallygrove.plans import standin as st
from tallygrove.plans.standin import ctes, read
from tallygrove.sources import delimited, staged

DISTRICT = ["state", "district"]
RACE = ["cycle", *DISTRICT]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir), with its SQL if there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Flagship: scan, as-of filter, two sums, joins, margin, top N, allocation.
FLAGSHIP_SQL = ctes("contributions", "results") + """, spent AS (
  SELECT o_custkey AS cand_id, CAST(sum(cents) // 100 AS BIGINT) AS total_trans FROM contributions JOIN orders ON o_orderkey = cmte_id WHERE cycle = 1996 AND txn_date <= DATE '1996-09-06' GROUP BY 1
), rows AS (
  SELECT r.*, coalesce(total_trans, 0) AS total_trans FROM results r LEFT JOIN spent USING (cand_id) WHERE cycle = 1996 AND party_major IN ('D', 'R')
  QUALIFY row_number() OVER (PARTITION BY state, district, party_major ORDER BY votes DESC, last_name, cand_id) = 1
), pairs AS (
  SELECT * FROM rows WHERE margin BETWEEN -0.999999 AND 0.999999 QUALIFY count(DISTINCT party_major) OVER (PARTITION BY state, district) = 2
), top AS (SELECT * FROM pairs WHERE party_major = 'D' ORDER BY total_trans DESC, state, district LIMIT 10)
SELECT cand_id, state, district, total_trans, round(margin, 6) AS margin, coalesce(abs(margin) < 0.05, false) AS is_close,
  round(CASE WHEN sum(total_trans) OVER () > 0 THEN 100.0 * total_trans / sum(total_trans) OVER () ELSE 100.0 / count(*) OVER () END, 4) AS allocation FROM top"""  # fmt: skip


@query(FLAGSHIP_SQL)
def q_flagship(spark: SparkSession, d: str) -> DataFrame:
    gave = mo.as_of(st.contributions(spark, d).where("cycle = 1996"), st.FLAGSHIP_CUTOFF)
    spent = gave.groupBy("cmte_id").agg(F.sum("cents").alias("cents")).join(st.linkage(spark, d), "cmte_id").groupBy("cand_id").agg(F.floor(F.sum("cents") / 100).alias("total_trans"))
    rows = rs.top_of_party(st.results(spark, d).where((F.col("cycle") == 1996) & F.col("party_major").isin("D", "R")).join(spent, "cand_id", "left"), DISTRICT)
    rows = rs.contested(rows.withColumn("total_trans", nx.number(F.col("total_trans"), "bigint")), DISTRICT)
    out = al.allocate(rows.where("party_major = 'D'"), "total_trans", 100.0, 10)
    return out.select("cand_id", *DISTRICT, "total_trans", F.round("margin", 6).alias("margin"), al.is_close().alias("is_close"), F.round("allocation", 4).alias("allocation"))


@query(ctes("contributions") + "SELECT source, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, strftime(max(txn_date), '%Y-%m-%d') AS last_day FROM contributions WHERE txn_date <= DATE '1996-09-06' GROUP BY source")
def q_flt_snapshot_inclusive(spark, d):
    rows = mo.as_of(st.contributions(spark, d), st.FLAGSHIP_CUTOFF)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.date_format(F.max("txn_date"), "yyyy-MM-dd").alias("last_day"))


@query("""SELECT CAST(strftime(l_shipdate, '%Y') AS INT) AS y, count(*) AS n, count(a) AS n_a, count(b) AS n_b, strftime(min(a), '%Y-%m-%d') AS first_a, strftime(max(b), '%Y-%m-%d') AS last_b FROM (
  SELECT l_shipdate, CASE WHEN l_orderkey % 17 <> 0 THEN CAST(l_shipdate AS DATE) END AS a, CASE WHEN year(l_shipdate) >= 2000 THEN CAST(l_shipdate AS DATE) END AS b FROM lineitem) GROUP BY 1""")
def q_flt_snapshot_text_dates(spark, d):
    """Dates as bulk files write them, some unreadable, parsed leniently."""
    rows = read(spark, d, "lineitem").select("l_shipdate", F.when(F.col("l_orderkey") % 17 == 0, "BADDATE9").otherwise(F.regexp_replace(F.date_format("l_shipdate", "MMddyyyy"), "^0", "")).alias("mdy"), F.when(F.year("l_shipdate") >= 2000, F.upper(F.date_format("l_shipdate", "dd-MMM-yy"))).otherwise("??").alias("dmy"))
    rows = rows.withColumns({"a": dates.from_mmddyyyy(F.col("mdy")), "b": dates.from_dd_mon_yy(F.col("dmy"))})
    return rows.groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.min("a").cast("string").alias("first_a"), F.max("b").cast("string").alias("last_b"))


@query(ctes("contested") + "SELECT cycle, state, district, party_major, cand_id, votes, round(margin, 6) AS margin FROM contested")
def q_flt_contested_pair(spark, d):
    rows = rs.contested(rs.top_of_party(st.results(spark, d).where(F.col("party_major").isin("D", "R")), RACE), RACE)
    return rows.select(*RACE, "party_major", "cand_id", "votes", F.round("margin", 6).alias("margin"))


@query(ctes("topped", "ratings") + "SELECT cycle, count(*) FILTER (party_major = 'D') AS n_all, count(*) FILTER (party_major = 'D' AND cook_rating IS NOT NULL) AS n_rated FROM topped LEFT JOIN ratings USING (state, district) GROUP BY cycle")
def q_flt_universe(spark, d):
    from tallygrove.plans.backtest import universe

    rows = rs.top_of_party(st.results(spark, d).where(F.col("party_major").isin("D", "R")), RACE).join(st.ratings(spark, d), DISTRICT, "left")
    a = universe(rows, "all", "full").groupBy("cycle").agg(F.count("*").alias("n_all"))
    return a.join(universe(rows, "wikipedia", "full").groupBy("cycle").agg(F.count("*").alias("n_rated")), "cycle")


_FILLED = "coalesce(cook_rating, CASE WHEN cpvi >= 10 THEN 7.0 WHEN cpvi >= 3 THEN 6.0 WHEN cpvi > -3 THEN 4.0 WHEN cpvi > -10 THEN 2.0 ELSE 1.0 END)::DOUBLE"


@query(ctes("races") + f""", ladder AS (SELECT * FROM (VALUES ('naive', 1, 2), ('naive+pvi', 2, 3), ('naive+pvi+demo', 3, 11), ('naive+pvi+demo+fund', 4, 13), ('naive+pvi+demo+fund+opp', 5, 14), ('full', 6, 16)) t(feature_set, step, n_columns))
SELECT feature_set, CAST(step AS INT) AS step, CAST(n_columns AS INT) AS n_columns, count(*) FILTER (step > 1 OR cook_rating IS NOT NULL) AS n_scorable,
  round(sum(CASE WHEN step = 1 THEN coalesce(-abs(cook_rating - 4), 0) ELSE {_FILLED} END) + sum(incumbent) + sum(CASE WHEN step > 1 THEN cpvi ELSE 0 END) + sum(CASE WHEN step > 2 THEN acs_median_income ELSE 0 END) + sum(CASE WHEN step > 4 THEN opp_raised_log ELSE 0 END) + sum(CASE WHEN step > 5 THEN ie_against_log ELSE 0 END), 2) AS total
FROM races, ladder GROUP BY ALL""")
def q_prj_feature_ladder(spark, d):
    """Each feature set's columns over all races: how many rows it can score, and the sum of its features."""
    from tallygrove.plans.models import design, feature_columns, scorable

    names, out = ["naive", "naive+pvi", "naive+pvi+demo", "naive+pvi+demo+fund", "naive+pvi+demo+fund+opp", "full"], None
    races = st.races(spark, d)
    races = races.withColumns({c: F.lit(0.0) for c in feature_columns("full") if c not in races.columns})
    for i, n in enumerate(names):
        total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
        own = design(races, n).agg(F.lit(n).alias("feature_set"), F.lit(i + 1).alias("step"), F.first(F.size("features")).alias("n_columns"), F.count_if(scorable(n)).alias("n_scorable"), F.round(F.sum(total), 2).alias("total"))
        out = own if out is None else out.unionByName(own)
    return out


MATRIX_SQL = ctes("topped", "ratings", "money") + """, spending AS (
  SELECT cycle, snapshot, cand_id, CAST(s // 100 AS BIGINT) AS ie_for_total, CAST(o // 100 AS BIGINT) AS ie_against_total FROM (
    SELECT t.cycle, snapshot, o_custkey AS cand_id, coalesce(sum(cents) FILTER (flag = 'R'), 0) AS s, coalesce(sum(cents) FILTER (flag = 'A'), 0) AS o
    FROM contributions t JOIN cutoffs k ON t.cycle = k.cycle AND txn_date <= cutoff JOIN orders ON o_orderkey = cmte_id GROUP BY ALL)
), joined AS (
  SELECT t.*, g.cook_rating, g.cpvi, m.snapshot, m.total_trans, s.ie_for_total, s.ie_against_total FROM topped t LEFT JOIN ratings g USING (state, district) LEFT JOIN money m USING (cycle, cand_id) LEFT JOIN spending s USING (cycle, snapshot, cand_id)
  WHERE m.snapshot IS NOT NULL AND t.margin BETWEEN -0.999999 AND 0.999999
), pairs AS (SELECT * FROM joined QUALIFY count(DISTINCT party_major) OVER (PARTITION BY cycle, snapshot, state, district) = 2
), matrix AS (
  SELECT *, margin AS margin_pct, CASE WHEN cand_ici = 'I' THEN 1 ELSE 0 END AS incumbent, CAST(sum(total_trans) OVER (PARTITION BY cycle, snapshot, state, district) - total_trans AS BIGINT) AS opp_raised FROM pairs
)
"""


def matrix(spark, d):
    """The feature matrix of all cycles and snapshots; one scan of the contributions serves all sums."""
    keys = ["cycle", "snapshot"]
    parts = {"i": F.col("source") == "indiv", "c": F.col("source") == "cmte", "s": F.col("flag") == "R", "o": F.col("flag") == "A"}
    sums = mo.as_of_sums(st.contributions(spark, d), st.cutoffs(spark), st.linkage(spark, d), parts)
    money = mo.in_whole(sums, [*keys, "cand_id"], {"total_trans": F.col("i") + F.col("c"), "trans_by_indiv": F.col("i"), "trans_by_cmte": F.col("c"), "ie_for_total": F.col("s"), "ie_against_total": F.col("o")})
    g = st.ratings(spark, d)
    cycles = spark.createDataFrame([(c,) for c in st.ELECTIONS], "cycle int")
    rated = g.crossJoin(F.broadcast(cycles))  # three cycles
    return ft.build(st.results(spark, d), rated, rated.select("cycle", *DISTRICT, "cpvi"), g.select(*DISTRICT), money, None)


@query(MATRIX_SQL + """SELECT cycle, snapshot, state, district, party_major, cand_id, round(margin_pct, 6) AS margin_pct, cook_rating, cpvi, incumbent, total_trans, opp_raised, ie_for_total, ie_against_total,
  round(ln(1 + total_trans), 6) AS self_raised_log, round(CASE WHEN total_trans + opp_raised > 0 THEN total_trans / CAST(total_trans + opp_raised AS DOUBLE) ELSE 0.5 END, 6) AS self_raised_pct, round(ln(1 + ie_for_total), 6) AS ie_for_log FROM matrix""")
def q_orc_feature_matrix(spark, d):
    m = matrix(spark, d)
    return m.select("cycle", "snapshot", *DISTRICT, "party_major", "cand_id", F.round("margin_pct", 6).alias("margin_pct"), "cook_rating", "cpvi", "incumbent", "total_trans", "opp_raised", "ie_for_total", "ie_against_total", F.round("self_raised_log", 6).alias("self_raised_log"), F.round("self_raised_pct", 6).alias("self_raised_pct"), F.round("ie_for_log", 6).alias("ie_for_log"))


@query(MATRIX_SQL + """SELECT 'margin_range' AS "check", count(*) FILTER (NOT coalesce(margin_pct BETWEEN -0.999999 AND 0.999999, false)) AS n FROM matrix
UNION ALL SELECT 'district_pairs', count(*) FILTER (n <> 2 OR s <> 2) FROM (SELECT count(*) AS n, count(DISTINCT party_major) AS s FROM matrix GROUP BY cycle, snapshot, state, district)""")
def q_chk_invariants(spark, d):
    return ft.violations(matrix(spark, d), ["cycle", "snapshot", *DISTRICT])


LEAK_SQL = """SELECT rule, count(*) AS n FROM (
  SELECT CASE WHEN src = 'wikipedia' AND cycle IN (2014, 2016, 2018) THEN CASE WHEN NOT leaky THEN 'backfilled_not_flagged' END
    WHEN src = 'wayback_cook' THEN CASE WHEN leaky THEN 'archive_flagged' WHEN day > snap + 30 THEN 'archive_too_late' END
    WHEN leaky THEN 'clean_flagged' WHEN day > snap THEN 'after_snapshot' END AS rule
  FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'wikipedia' ELSE 'wayback_cook' END AS src, CAST(2014 + 2 * (event_id % 6) AS INT) AS cycle, event_id % 5 = 0 AS leaky, CAST(ts AS DATE) AS day, DATE '2024-01-01' + CAST(event_id % 20 AS INT) - 10 AS snap FROM events)
) WHERE rule IS NOT NULL GROUP BY rule"""


@query(LEAK_SQL)
def q_chk_leakage_audit(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select(F.when(e % 2 == 0, "wikipedia").otherwise("wayback_cook").alias("ratings_source"), (2014 + 2 * (e % 6)).cast("int").alias("cycle"), (e % 5 == 0).alias("leaky_ratings"), F.to_date("ts").alias("ratings_day"), F.date_add(F.lit("2024-01-01").cast("date"), (e % 20 - 10).cast("int")).alias("snapshot_date"))
    return ft.leaks(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query(ctes("contributions", "candidates") + """SELECT cand_id, state, district, party_major, CAST((i + c) // 100 AS BIGINT) AS total_trans, CAST(i // 100 AS BIGINT) AS trans_by_indiv, CAST(c // 100 AS BIGINT) AS trans_by_cmte FROM (
  SELECT o_custkey AS cand_id, coalesce(sum(cents) FILTER (source = 'indiv'), 0) AS i, coalesce(sum(cents) FILTER (source = 'cmte'), 0) AS c FROM contributions JOIN orders ON o_orderkey = cmte_id GROUP BY 1) JOIN candidates USING (cand_id) WHERE office = 'H'""")
def q_join_committee_candidate(spark, d):
    sums = st.contributions(spark, d).groupBy("cmte_id").agg(*(F.coalesce(F.sum(F.when(F.col("source") == s, F.col("cents"))), F.lit(0)).alias(f"by_{s}") for s in ("indiv", "cmte")))
    totals = mo.candidate_totals(sums, st.linkage(spark, d), [])
    return mo.with_master(totals, st.candidates(spark, d)).select("cand_id", *DISTRICT, "party_major", "total_trans", "trans_by_indiv", "trans_by_cmte")


@query(ctes("contributions") + "SELECT cmte_id, CAST(coalesce(sum(cents) FILTER (source = 'indiv'), 0) AS BIGINT) AS by_indiv, CAST(coalesce(sum(cents) FILTER (source = 'cmte'), 0) AS BIGINT) AS by_cmte FROM contributions GROUP BY cmte_id")
def q_join_outer_align(spark, d):
    return mo.aligned(st.contributions(spark, d), [])


@query(ctes("candidates", "ratings") + "SELECT cand_id, state, district, coalesce(CASE WHEN cand_id % 4 = 0 THEN CAST(cand_id % 9 AS INT) END, cpvi) AS cpvi FROM candidates LEFT JOIN ratings USING (state, district)")
def q_join_coalesce_fallback(spark, d):
    rows = st.candidates(spark, d).withColumn("own", F.when(F.col("cand_id") % 4 == 0, (F.col("cand_id") % 9).cast("int")))
    return rows.join(st.ratings(spark, d), DISTRICT, "left").select("cand_id", *DISTRICT, F.coalesce("own", "cpvi").alias("cpvi"))


@query(ctes("candidates", "results") + """SELECT cycle, state, district, party_major, cand_id, record_id, votes FROM (
  SELECT r.cycle, r.state, r.district, r.party_major, r.cand_id, c.cand_id AS record_id, votes, row_number() OVER (PARTITION BY r.cycle, r.state, r.district, r.party_major ORDER BY coalesce(balance, 0) DESC, c.last_name, c.cand_id, r.cand_id) AS rn
  FROM results r LEFT JOIN (SELECT * FROM candidates WHERE cand_id % 5 <> 0) c USING (state, district, last_name)) WHERE rn = 1""")
def q_join_exact_name_dedup(spark, d):
    records = st.candidates(spark, d).where("cand_id % 5 <> 0").select(*DISTRICT, "last_name", "party_major", F.col("cand_id").alias("record_id"), "balance")
    both = mt.exact(st.results(spark, d), records).withColumn("_n", F.when(F.col("record_id").isNotNull(), F.col("last_name")))
    return rs.top_of_party(both, RACE, "balance", ("_n", "record_id", "cand_id")).select(*RACE, "party_major", "cand_id", "record_id", "votes")


@query()
def q_join_fuzzy_ro(spark, d):
    """Misspelt part names against the full list, within a block: the exact ratio needs the standard library."""
    p = read(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").alias("state"), (F.col("p_partkey") % 5).cast("int").alias("district"), F.when(F.col("p_partkey") % 2 == 0, "D").otherwise("R").alias("party_major"))
    rows = p.select(F.col("p_partkey").alias("row_id"), "state", "district", F.concat(F.substring("p_name", 1, 4), F.expr("substring(p_name, 6)")).alias("last_name"), "party_major")
    return mt.fuzzy(rows, p.select(F.col("p_partkey").alias("cand_id"), "state", "district", F.upper("p_name").alias("last_name"), "party_major"))


@query(ctes("ratings") + """SELECT coalesce(w.state, a.state) AS state, coalesce(w.district, a.district) AS district, cpvi, coalesce(a.cook_rating, w.cook_rating) AS cook_rating, CASE WHEN a.cook_rating IS NOT NULL THEN 'archive' ELSE 'wiki' END AS ratings_source
FROM (SELECT * FROM ratings WHERE state % 2 = 0) w FULL JOIN (SELECT state, district, 8.0::DOUBLE - cook_rating AS cook_rating FROM ratings WHERE district < 5) a USING (state, district)""")
def q_join_overlay(spark, d):
    g = st.ratings(spark, d)
    return mt.overlay(g.where("state % 2 = 0"), g.where("district < 5").select(*DISTRICT, (8.0 - F.col("cook_rating")).alias("cook_rating")), DISTRICT, "cook_rating")


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'N1' WHEN 'NATION_2' THEN 'N2' END AS code FROM nation")
def q_join_map_lookup(spark, d):
    return read(spark, d, "nation").select("n_nationkey", fx.mapped(F.col("n_name"), {"NATION_1": "N1", "NATION_2": "N2"}).alias("code"))


@query(ctes("money") + "SELECT * FROM money")
def q_agg_all_snapshots(spark, d):
    return st.money(spark, d)


@query(ctes("contributions") + """SELECT o_custkey AS cand_id, CAST(coalesce(sum(cents) FILTER (flag = 'R'), 0) // 100 AS BIGINT) AS ie_for_total, CAST(coalesce(sum(cents) FILTER (flag = 'A'), 0) // 100 AS BIGINT) AS ie_against_total FROM contributions JOIN orders ON o_orderkey = cmte_id GROUP BY 1""")
def q_agg_support_oppose_pivot(spark, d):
    rows = st.contributions(spark, d).join(st.linkage(spark, d), "cmte_id").withColumn("sup_opp", F.when(F.col("flag") == "R", "S").when(F.col("flag") == "A", "O").otherwise("N"))
    return mo.support_oppose(rows, ["cand_id"])


@query(MATRIX_SQL + "SELECT cycle, snapshot, state, district, party_major, opp_raised, round(CASE WHEN total_trans + opp_raised > 0 THEN total_trans / CAST(total_trans + opp_raised AS DOUBLE) ELSE 0.5 END, 6) AS self_raised_pct FROM matrix")
def q_agg_opponent_share(spark, d):
    return matrix(spark, d).select("cycle", "snapshot", *DISTRICT, "party_major", "opp_raised", F.round("self_raised_pct", 6).alias("self_raised_pct"))


@query(ctes("results") + "SELECT DISTINCT cycle, state, district, round(margin, 6) AS margin FROM results")
def q_agg_two_party_margin(spark, d):
    return st.results(spark, d).select(*RACE, F.round("margin", 6).alias("margin")).distinct()


@query(ctes("results") + "SELECT cycle, cand_id, votes, winner FROM results")
def q_agg_winner_flag(spark, d):
    return st.results(spark, d).select("cycle", "cand_id", "votes", "winner")


@query(ctes("results") + """SELECT cycle, state, district, CASE WHEN d > 0 AND r > 0 THEN 'contested' WHEN d > 0 THEN 'd_lock' WHEN r > 0 THEN 'r_lock' ELSE 'other_lock' END AS status, winner_party, round(vd / CAST(nullif(vd + vr, 0) AS DOUBLE), 6) AS d_two_party_share FROM (
  SELECT cycle, state, district, count(*) FILTER (party_major = 'D') AS d, count(*) FILTER (party_major = 'R') AS r, arg_max(coalesce(party_major, 'OTHER'), (votes, -cand_id)) AS winner_party, coalesce(sum(votes) FILTER (party_major = 'D'), 0) AS vd, coalesce(sum(votes) FILTER (party_major = 'R'), 0) AS vr FROM results GROUP BY ALL)""")
def q_agg_chamber_view(spark, d):
    return rs.chamber(st.results(spark, d), RACE).withColumn("d_two_party_share", F.round("d_two_party_share", 6))


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.025), 4) AS lo, round(quantile_cont(c_acctbal, 0.5), 4) AS mid, round(quantile_cont(c_acctbal, 0.975), 4) AS hi FROM customer GROUP BY 1")
def q_agg_percentile_ci(spark, d):
    out = percentiles(read(spark, d, "customer"), "c_acctbal", [0.025, 0.5, 0.975], ("c_mktsegment",), "_q")
    return out.select("c_mktsegment", *(F.round(F.get("_q", F.lit(i)), 4).alias(n) for i, n in enumerate(("lo", "mid", "hi"))))


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 4) AS low, round(quantile_cont(l_extendedprice, 0.5), 4) AS mid, round(quantile_cont(l_extendedprice, 0.999), 4) AS high FROM lineitem GROUP BY ALL")
def q_agg_percentile_rounds(spark, d):
    """Selection in several rounds: a range is only sorted when it has come down to 500 rows."""
    out = percentiles(read(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.999], ("l_returnflag", "l_linestatus"), "_q", few=500)
    return out.select("l_returnflag", "l_linestatus", *(F.round(F.get("_q", F.lit(i)), 4).alias(n) for i, n in enumerate(("low", "mid", "high"))))


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std FROM customer GROUP BY 1")
def q_agg_mean_popstd(spark, d):
    return read(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 4).alias("std"))


@query("""SELECT bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(CAST(c AS INT)), 6) AS close_rate FROM (
  SELECT s, c, CAST(greatest(ceil((s - lo) / ((hi - lo) / 7)), 1) AS BIGINT) AS bin FROM (SELECT c_acctbal AS s, c_custkey % 3 = 0 AS c, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () AS hi FROM customer)) GROUP BY bin""")
def q_agg_calibration_bins(spark, d):
    from tallygrove.plans.backtest import calibration_bins

    rows = read(spark, d, "customer").select(F.col("c_acctbal").alias("s"), F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(1.0).alias("margin_pct"))
    return calibration_bins(rows, "s").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("close_rate", 6).alias("close_rate"))


@query(ctes("topped", "ratings") + "SELECT cook_rating, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std FROM (SELECT cook_rating, margin - (coalesce(cpvi, 0) / 100.0::DOUBLE) AS r FROM topped LEFT JOIN ratings USING (state, district) WHERE party_major = 'D' AND margin IS NOT NULL) GROUP BY 1")
def q_agg_residual_by_bucket(spark, d):
    from tallygrove.plans.backtest import residuals

    rows = rs.top_of_party(st.results(spark, d).where(F.col("party_major").isin("D", "R")), RACE).where("party_major = 'D' and margin is not null").join(st.ratings(spark, d), DISTRICT, "left")
    rows = rows.select("cook_rating", F.col("margin").alias("margin_pct"), (F.coalesce("cpvi", F.lit(0)) / 100.0).alias("predicted_margin_median"))
    return residuals(rows).select("cook_rating", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(ctes("topped") + "SELECT cycle, state, district, party_major, cand_id, votes FROM topped")
def q_win_top_per_group(spark, d):
    return rs.top_of_party(st.results(spark, d).where(F.col("party_major").isin("D", "R")), RACE).select(*RACE, "party_major", "cand_id", "votes")


@query(ctes("results") + "SELECT cycle, cand_id, total_votes, round(vote_share, 6) AS vote_share FROM results")
def q_win_vote_share(spark, d):
    return st.results(spark, d).select("cycle", "cand_id", "total_votes", F.round("vote_share", 6).alias("vote_share"))


@query("SELECT c_custkey, c_nationkey AS state, CAST(c_custkey % 10 AS INT) AS district, CAST(c_custkey % 4 AS DOUBLE) AS score FROM customer ORDER BY score DESC, state, district, c_custkey LIMIT 25")
def q_top_n_tiebreak(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("state"), (F.col("c_custkey") % 10).cast("int").alias("district"), (F.col("c_custkey") % 4).cast("double").alias("score"))
    return al.allocate(rows, "score", 1.0, 25, ("state", "district", "c_custkey")).drop("allocation")


LINES_SQL = """, dems AS (SELECT state, district, margin_pct, CAST(total_trans AS DOUBLE) AS fundraising, CASE WHEN abs(margin_pct) < 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS oracle, CASE WHEN cook_rating IS NULL THEN 0.0 ELSE greatest(4 - abs(cook_rating - 4), 1.0) END::DOUBLE AS final_ratings
  FROM matrix WHERE party_major = 'D' AND cycle = 1998 AND snapshot = 'T-60'
), long AS (SELECT state, district, margin_pct, 'fundraising' AS line, fundraising AS w FROM dems UNION ALL SELECT state, district, margin_pct, 'oracle', oracle FROM dems UNION ALL SELECT state, district, margin_pct, 'final_ratings', final_ratings FROM dems
), ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY w DESC, state, district) AS rk FROM long)
"""  # fmt: skip


def dems_1998(spark, d):
    from tallygrove.plans.backtest import with_lines

    m = matrix(spark, d).where("party_major = 'D' and cycle = 1998 and snapshot = 'T-60'")
    return with_lines(m.withColumn("final_rating", F.col("cook_rating")), "total_trans")


@query(MATRIX_SQL + LINES_SQL + """, cut AS (SELECT line, n, margin_pct, CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 1.0 / count(*) OVER p END AS part FROM ranked, (VALUES (1), (3), (5), (10), (20), (50)) g(n) WHERE rk <= n WINDOW p AS (PARTITION BY line, n))
SELECT line, n, round(coalesce(sum(part) FILTER (abs(margin_pct) < 0.05), 0) / sum(part), 4) AS close_share FROM cut GROUP BY line, n""")
def q_top_n_grid(spark, d):
    from tallygrove.plans.backtest import shares_at

    return shares_at(dems_1998(spark, d), lines=("fundraising", "oracle", "final_ratings"))


@query("SELECT c_nationkey AS alpha, round(avg(c_acctbal), 4) AS metric FROM customer GROUP BY 1 ORDER BY metric DESC, alpha LIMIT 1")
def q_top_best_alpha(spark, d):
    from tallygrove.plans.backtest import best_row

    return best_row(read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("alpha")).agg(F.round(F.avg("c_acctbal"), 4).alias("metric")), "metric")


@query(ctes("results") + "SELECT cycle, count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM results WHERE cycle IN (1996, 2000) GROUP BY cycle")
def q_set_union_cycles(spark, d):
    from tallygrove.plans.backtest import stacked

    r = st.results(spark, d)
    return stacked([r.where("cycle = 1996"), r.where("cycle = 2000").drop("cand_ici")]).groupBy("cycle").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"))


@query("""SELECT c_custkey, 'CUSTOMER' || CASE WHEN c_custkey % 3 = 0 THEN ' O''NEIL' ELSE '' END AS a, CASE WHEN c_custkey % 2 = 0 THEN 'CUSTOMER' || CASE WHEN c_custkey % 3 = 0 THEN ' O''NEIL' ELSE '' END ELSE 'SMITH-LEE' END AS b FROM customer""")
def q_str_surname(spark, d):
    rows = read(spark, d, "customer").withColumn("n", F.concat(F.lit(" Customer"), F.when(F.col("c_custkey") % 3 == 0, " O'Neil").otherwise(""), F.lit(", Ann B. ")))
    return rows.select("c_custkey", fx.surname(F.col("n")).alias("a"), fx.surname_any(F.when(F.col("c_custkey") % 2 == 0, F.col("n")).otherwise("Ann B. Smith-Lee.")).alias("b"))


PLACES = ("Pennsylvania {}", "CA-{}", "Alaska at-large", "Puerto Rico {}", "AL-0{}", "ALABAMA-{}", "AK-AL", "MT-AT-LARGE", "Alaska  At-Large", "Mars {}", "", "Total")


@query("""SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN 'PA' WHEN 1 THEN 'CA' WHEN 2 THEN 'AK' WHEN 4 THEN 'AL' WHEN 5 THEN 'AL' WHEN 6 THEN 'AK' WHEN 7 THEN 'MT' WHEN 8 THEN 'AK' END AS state,
  CAST(CASE WHEN c_custkey % 12 IN (0, 1, 4, 5) THEN c_nationkey WHEN c_custkey % 12 IN (2, 6, 7, 8) THEN 0 END AS INT) AS district FROM customer""")
def q_str_district_parse(spark, d):
    """Places in twelve spellings; those of no state are null."""
    spelled = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("c_custkey") % len(PLACES) + 1).cast("int"))
    rows = read(spark, d, "customer").withColumn("n", F.replace(spelled, F.lit("{}"), F.col("c_nationkey").cast("string")))
    rows = rows.withColumn("p", F.coalesce(fx.district_label(F.col("n")), fx.district_code(F.col("n"))))
    return rows.select("c_custkey", F.col("p.state").alias("state"), F.col("p.district").alias("district"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN -p_size WHEN 1 THEN p_size ELSE 0 END AS cpvi FROM part""")
def q_str_signed_index(spark, d):
    k = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", fx.signed_index(F.when(k % 3 == 0, F.concat(F.lit(" R+"), k)).when(k % 3 == 1, F.concat(F.lit("D + "), k)).otherwise("Even")).alias("cpvi"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 3.5 WHEN 2 THEN 4.0 WHEN 3 THEN 7.0 END::DOUBLE AS rating, p_size % 5 = 2 AS flip FROM part""")
def q_str_rating_ordinal(spark, d):
    label = F.element_at(F.array(*map(F.lit, ["Solid R", " tilt R ", "Toss-up (Flip)", "Safe D", "unknown"])), F.col("p_size") % 5 + 1)
    return read(spark, d, "part").select("p_partkey", fx.rating_ordinal(label).alias("rating"), fx.any_contains([label, F.col("p_brand")], "flip").alias("flip"))


@query("""SELECT p_partkey, arg_min(w, (length(w), w)) AS hit FROM (SELECT p_partkey, upper(p_name) AS n FROM part), (VALUES ('RED'), ('BLUE'), ('PART'), ('1'), ('GREEN'), ('STEEL')) v(w) WHERE contains(n, w) OR contains(w, n) GROUP BY 1""")
def q_str_containment(spark, d):
    words = spark.createDataFrame([("RED",), ("BLUE",), ("PART",), ("1",), ("GREEN",), ("STEEL",)], "w string")
    rows = read(spark, d, "part").select("p_partkey", F.upper("p_name").alias("n")).crossJoin(F.broadcast(words))  # six words
    return rows.where(fx.either_contains(F.col("n"), F.col("w"))).groupBy("p_partkey").agg(F.min_by("w", F.struct(F.length("w"), "w")).alias("hit"))


@query(ctes("cutoffs") + """SELECT cycle, snapshot, strftime(cutoff, '%Y-%m-%d') AS cutoff, isodow(election) = 2 AS tuesday, count(*) FILTER (o_orderdate <= cutoff) AS n_before, count(*) FILTER (o_orderdate > cutoff) AS n_after FROM cutoffs JOIN orders ON year(o_orderdate) = cycle GROUP BY ALL""")
def q_dat_cutoffs(spark, d):
    """Each snapshot's cutoff, and how many of its year's orders lie on either side."""
    rows = read(spark, d, "orders").join(F.broadcast(st.cutoffs(spark)), F.year("o_orderdate") == F.col("cycle"))  # nine cutoffs
    sides = [F.count_if(F.col("o_orderdate") <= F.col("cutoff")).alias("n_before"), F.count_if(F.col("o_orderdate") > F.col("cutoff")).alias("n_after")]
    return rows.groupBy("cycle", "snapshot", F.col("cutoff").cast("string").alias("cutoff"), (F.weekday("election") == 1).alias("tuesday")).agg(*sides)


@query("SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS logged, least(greatest(c_acctbal, 0.0), 5000.0) AS clipped FROM customer")
def q_mth_log_clip(spark, d):
    b = F.col("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", F.round(F.log1p(nx.clip(b, 0.0)), 6).alias("logged"), nx.clip(b, 0.0, 5000.0).alias("clipped"))


@query("""SELECT c_custkey, round(sqrt(a * b), 6) AS base, round(need, 6) AS need, round(least(greatest(sqrt(a * b) * (1 + 0.3 * need), 0), 1), 6) AS impact FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE (c_custkey % 13) / 13.0::DOUBLE END AS a, least((c_custkey % 9) / 6.0::DOUBLE, 1.0) AS b, least(greatest((5000.0 - c_acctbal) / 5000.0, 0), 1) AS need FROM customer)""")
def q_mth_impact_combine(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select("c_custkey", nx.geometric_mean(F.when(k % 7 != 0, (k % 13) / 13.0), (k % 9) / 6.0).alias("base"), nx.need(F.col("c_acctbal"), F.lit(5000.0)).alias("need"))
    return rows.select("c_custkey", F.round("base", 6).alias("base"), F.round("need", 6).alias("need"), F.round(nx.need_boost(F.col("base"), F.col("need"), 0.3), 6).alias("impact"))


@query(ctes("ratings") + "SELECT state, district, CASE WHEN cook_rating IS NULL THEN 0.0 ELSE greatest(4 - abs(cook_rating - 4), 1.0) END::DOUBLE AS w, -abs(cook_rating - 4) AS dist FROM ratings")
def q_mth_symmetric_weight(spark, d):
    return st.ratings(spark, d).select(*DISTRICT, nx.tossup_weight(F.col("cook_rating")).alias("w"), nx.tossup_distance(F.col("cook_rating")).alias("dist"))


@query("SELECT c_custkey, round(CASE WHEN max(c_acctbal) OVER w - min(c_acctbal) OVER w < 1e-12 THEN 0.5 ELSE (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) END, 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def q_mth_minmax(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(nx.min_max(F.col("c_acctbal"), Window.partitionBy("c_nationkey")), 6).alias("scaled"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / CASE WHEN stddev_pop(c_acctbal) OVER w = 0 THEN 1 ELSE stddev_pop(c_acctbal) OVER w END, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def q_mth_zscore(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(nx.z_score(F.col("c_acctbal"), Window.partitionBy("c_nationkey")), 6).alias("z"))


KNOTS_SQL = """WITH knots AS (SELECT vec_id, list_sort(list_transform(embedding[1:9], lambda x: CAST(x AS DOUBLE))) AS xs, embedding FROM embeddings)
"""
LEVEL_SQL = "[0.025, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.975]::DOUBLE[]"


def _interp_sql(x: str, low: str, high: str) -> str:
    k = f"len(list_filter(xs, lambda v: v <= {x}))"
    return f"CASE WHEN {k} = 0 THEN {low} WHEN {k} = 9 AND {x} > xs[9] THEN {high} WHEN {k} = 9 THEN ys[9] ELSE ys[{k}] + ({x} - xs[{k}]) * (ys[{k} + 1] - ys[{k}]) / (xs[{k} + 1] - xs[{k}]) END"


def knots(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double")).alias("raw"), "embedding").withColumn("xs", F.array_sort("raw"))


@query(KNOTS_SQL + f"SELECT vec_id, round({_interp_sql('0.03', 'ys[1]', 'ys[9]')}, 6) AS clamped, round({_interp_sql('0.03', '0.0', '1.0')}, 6) AS cdf FROM (SELECT *, {LEVEL_SQL} AS ys FROM knots)")
def q_mth_interp(spark, d):
    ys, x = F.array(*map(F.lit, nx.LEVELS)), F.lit(0.03)
    return knots(spark, d).select("vec_id", F.round(nx.interpolate(F.col("xs"), ys, x), 6).alias("clamped"), F.round(nx.interpolate(F.col("xs"), ys, x, F.lit(0.0), F.lit(1.0)), 6).alias("cdf"))


@query("""WITH cuts AS (SELECT quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM customer)
SELECT CAST(decile AS INT) AS decile, count(*) AS n FROM (SELECT least(1 + len(list_filter(c, lambda x: x <= c_acctbal)), 10) AS decile FROM customer, cuts) GROUP BY 1""")
def q_mth_decile(spark, d):
    from tallygrove.plans.backtest import apply_deciles, deciles

    rows = read(spark, d, "customer")
    return apply_deciles(rows, "c_acctbal", deciles(rows, "c_acctbal"), "decile").groupBy("decile").agg(F.count("*").alias("n"))


@query(ctes("ratings") + "SELECT state, district, coalesce(cook_rating, CASE WHEN cpvi >= 10 THEN 7.0 WHEN cpvi >= 3 THEN 6.0 WHEN cpvi > -3 THEN 4.0 WHEN cpvi > -10 THEN 2.0 ELSE 1.0 END)::DOUBLE AS rating FROM ratings")
def q_imp_pvi_ladder(spark, d):
    return st.ratings(spark, d).select(*DISTRICT, F.coalesce(nx.rating_from_index(F.col("cook_rating"), F.col("cpvi")), F.lit(4.0)).alias("rating"))


@query(KNOTS_SQL + f"SELECT vec_id, round(greatest({_interp_sql('0.05', '0.0', '1.0')} - ({_interp_sql('-0.05', '0.0', '1.0')}), 0), 6) AS p FROM (SELECT *, {LEVEL_SQL} AS ys FROM knots)")
def q_alg_close_probability(spark, d):
    return knots(spark, d).select("vec_id", F.round(nx.close_probability(F.col("raw")), 6).alias("p"))


@query("SELECT round(avg(CAST(len(list_filter(generate_series(2, 9), lambda i: embedding[i] < embedding[i - 1])) > 0 AS INT)), 6) AS crossing_rate FROM embeddings")
def q_alg_crossing_rate(spark, d):
    from tallygrove.plans.models import crossing_rate

    return crossing_rate(knots(spark, d), "raw").select(F.round("crossing_rate", 6).alias("crossing_rate"))


@query("""WITH top AS (SELECT c_custkey, greatest(c_acctbal, 0) AS w FROM customer ORDER BY w DESC, c_custkey LIMIT 20) SELECT c_custkey, round(1000 * w / sum(w) OVER (), 4) AS allocation FROM top""")
def q_alg_allocate(spark, d):
    return al.allocate(read(spark, d, "customer"), "c_acctbal", 1000.0, 20, ("c_custkey",)).select("c_custkey", F.round("allocation", 4).alias("allocation"))


@query("""WITH top AS (SELECT c_custkey, greatest(c_acctbal, 0) AS w, CAST(c_custkey % 50 AS DOUBLE) AS need FROM customer ORDER BY w DESC, c_custkey LIMIT 20), capped AS (SELECT c_custkey, w * least(1, need / greatest(sum(need) OVER (), 1)) AS w FROM top)
SELECT c_custkey, round(1000 * w / sum(w) OVER (), 4) AS allocation FROM capped""")
def q_alg_allocate_need_cap(spark, d):
    rows = read(spark, d, "customer").withColumn("need", (F.col("c_custkey") % 50).cast("double"))
    return al.allocate(rows, "c_acctbal", 1000.0, 20, ("c_custkey",), need="need").select("c_custkey", F.round("allocation", 4).alias("allocation"))


@query("""WITH wanted AS (SELECT DISTINCT user_id, DATE '2024-01-03' AS cutoff, user_id % 3 = 0 AS may_fill FROM events), known AS (
  SELECT user_id, event_id FROM events WHERE ts < TIMESTAMP '2024-01-04' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
), late AS (
  SELECT user_id, event_id FROM events WHERE user_id % 3 = 0 AND user_id NOT IN (SELECT user_id FROM known) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT w.user_id, strftime(cutoff, '%Y-%m-%d') AS cutoff, CASE WHEN k.user_id IS NOT NULL THEN k.event_id ELSE l.event_id END AS event_id, l.user_id IS NOT NULL AS backfilled
FROM wanted w LEFT JOIN known k USING (user_id) LEFT JOIN late l USING (user_id)""")
def q_src_asof_revision(spark, d):
    log = read(spark, d, "events")
    wanted = log.select("user_id", F.lit("2024-01-03").cast("date").alias("cutoff"), (F.col("user_id") % 3 == 0).alias("may_fill")).distinct()
    return staged.latest_revision(log, wanted, "user_id", "ts", "event_id").withColumn("cutoff", F.col("cutoff").cast("string"))


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer WHERE c_custkey % 9 <> 0""")
def q_src_delimited_lenient(spark, d):
    """Rows as a bulk file has them: too long ones go, short ones are padded, NA is missing."""
    k = F.col("c_custkey")
    line = F.concat_ws("|", k, "c_name", F.when(k % 5 == 0, "NA").otherwise(F.col("c_mktsegment")), F.when(k % 7 != 0, F.col("c_nationkey").cast("string")), F.when(k % 9 == 0, "x|y"))
    rows = delimited.split_lines(read(spark, d, "customer").select(line.alias("value")), ["c_custkey", "name", "segment", "nation"])
    return rows.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "name", "segment", "nation")


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS n_keys, max(json_extract_string(props, '$.k')) AS last_key FROM events GROUP BY 1")
def q_src_json_props(spark, d):
    rows = read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    again = rows.withColumn("k", F.from_json(F.to_json(F.struct("k")), "k string")["k"])
    return again.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_keys"), F.max("k").alias("last_key"))


@query()
def q_src_html_table_ro(spark, d):
    """Each page as a two-row table, read back by the UDTF."""
    from tallygrove.sources import html

    page = F.concat(F.lit("<table><tr><th>id</th><th colspan=2>url</th></tr><tr><td>"), F.col("page_id"), F.lit("</td><td>"), F.col("url"), F.lit("<td>x</table>"))
    return html.tables(read(spark, d, "pages").select("page_id", page.alias("html"))).select("page_id", "table_no", "row_no", "header", "cells")
