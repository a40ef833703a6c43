"""The driver's queries for legacy and survey operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.operators import legacy
from tallygrove.operators.regress import least_squares
from tallygrove.plans import standin as st
from tallygrove.plans.queries import query
from tallygrove.plans.standin import ctes, read


@query(ctes("results") + """SELECT r.cycle, r.cand_id, r.votes, p.votes AS last_term_votes FROM results r LEFT JOIN results p ON p.cand_id = r.cand_id AND p.cycle = r.cycle - 2""")
def q_leg_prior_term(spark, d):
    rows = st.results(spark, d).select("cycle", "cand_id", "votes")
    return legacy.prior_term(rows, ["cand_id"], "cycle", "votes").select("cycle", "cand_id", "votes", "last_term_votes")


@query("""SELECT o_orderkey, round(o_totalprice / 1000.0, 6) AS a_pct, round(o_totalprice / nullif(o_custkey % 4, 0), 6) AS b_pct FROM orders WHERE o_custkey % 4 <> 0""")
def q_leg_ratio_features(spark, d):
    rows = read(spark, d, "orders").withColumns({"_a": F.lit(1000.0), "_b": F.col("o_custkey") % 4})
    out = legacy.ratios(rows, {"a_pct": ("o_totalprice", "_a"), "b_pct": ("o_totalprice", "_b")})
    return legacy.model_rows(out, ["o_orderkey", "a_pct", "b_pct"], []).select("o_orderkey", F.round("a_pct", 6).alias("a_pct"), F.round("b_pct", 6).alias("b_pct"))


@query("""SELECT c_mktsegment, round(corr(c_acctbal, c_custkey), 6) AS r, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(min(c_acctbal), 4) AS low, round(max(c_acctbal), 4) AS high FROM customer GROUP BY 1""")
def q_cen_describe_corr(spark, d):
    f = lambda x, n: F.round(x, 4).alias(n)
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.corr("c_acctbal", F.col("c_custkey").cast("double")), 6).alias("r"), F.count("*").alias("n"), f(F.avg("c_acctbal"), "mean"), f(F.stddev_samp("c_acctbal"), "std"), f(F.min("c_acctbal"), "low"), f(F.max("c_acctbal"), "high"))


@query("""SELECT c_mktsegment, term, round(CASE term WHEN 'intercept' THEN b0 ELSE b1 END, 4) AS estimate, round(CASE term WHEN 'intercept' THEN s * sqrt(1.0 / n + xm * xm / sxx) ELSE s / sqrt(sxx) END, 5) AS std_error,
  round(CASE term WHEN 'intercept' THEN b0 / (s * sqrt(1.0 / n + xm * xm / sxx)) ELSE b1 * sqrt(sxx) / s END, 4) AS t, n, round(r2, 6) AS r2 FROM (
  SELECT c_mktsegment, regr_intercept(c_acctbal, c_custkey) AS b0, regr_slope(c_acctbal, c_custkey) AS b1, regr_sxx(c_acctbal, c_custkey) AS sxx, regr_avgx(c_acctbal, c_custkey) AS xm, count(*) AS n, regr_r2(c_acctbal, c_custkey) AS r2,
    sqrt((1 - regr_r2(c_acctbal, c_custkey)) * regr_syy(c_acctbal, c_custkey) / (count(*) - 2)) AS s FROM customer GROUP BY 1), (VALUES ('intercept'), ('c_custkey')) v(term)""")
def q_cen_least_squares(spark, d):
    """A line for each segment, with standard errors and t values."""
    out = least_squares(read(spark, d, "customer"), "c_acctbal", ["c_custkey"], ("c_mktsegment",))
    return out.select("c_mktsegment", "term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 5).alias("std_error"), F.round("t", 4).alias("t"), "n", F.round("r2", 6).alias("r2"))


@query("SELECT c_custkey AS a, c_acctbal AS b, c_name AS c FROM customer")
def q_cen_type_ladder(spark, d):
    text = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("a"), F.col("c_acctbal").cast("string").alias("b"), F.col("c_name").alias("c"))
    return legacy.typed(text, ["a", "b", "c"])
