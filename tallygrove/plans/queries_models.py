"""The driver's queries for simulation, bootstrap, models and the app's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions import numeric as nx
from tallygrove.operators import allocate as al
from tallygrove.operators import results as rs
from tallygrove.plans import backtest as bt
from tallygrove.plans import boosting, models, simulate
from tallygrove.plans import standin as st
from tallygrove.plans.queries import DISTRICT, KNOTS_SQL, LEVEL_SQL, LINES_SQL, MATRIX_SQL, RACE, _interp_sql, dems_1998, knots, matrix, query
from tallygrove.plans.standin import ctes, read
from tallygrove.session import saved

SEED, REPS, ITERATIONS = 42, 1000, 10_000
CLOSE_SHARE = "coalesce(sum(part) FILTER (abs(margin_pct) < 0.05), 0) / sum(part)"


def u_sql(stream: str, *numbers: str) -> str:
    """The replayable uniform in DuckDB."""
    key = " || ':' || ".join([f"'{SEED}:{stream}'", *(f"CAST({n} AS VARCHAR)" for n in numbers)])
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)"


def chamber(spark: SparkSession, d: str) -> DataFrame:
    """Quantile vectors of all seats."""
    return knots(spark, d).select(F.col("vec_id").alias("seat"), F.transform("xs", lambda x: x / 10.0).alias("quantiles"))


OUTCOME_SQL = KNOTS_SQL + f""", seats AS (SELECT vec_id AS seat, {LEVEL_SQL} AS xs, list_transform(xs, lambda x: x / 10.0) AS ys FROM knots
), draws AS (SELECT CAST(range AS INT) AS iter, 0.03 * (sqrt(-2 * ln({u_sql("shock/a", "range")})) * cos(2 * 3.141592653589793 * {u_sql("shock/b", "range")})) AS shock FROM range({ITERATIONS})
), uni AS (SELECT iter, seat, shock, xs, ys, {u_sql("seat", "iter", "seat")} AS u FROM draws, seats
), won AS (SELECT iter, seat, {_interp_sql("u", "ys[1]", "ys[9]")} + shock > 0 AS d_won FROM uni
), totals AS (SELECT iter, count(*) FILTER (d_won) + 3 AS total FROM won GROUP BY iter)
"""  # fmt: skip


@query(OUTCOME_SQL + """, bar AS (SELECT quantile_cont(total, 0.5) AS bar FROM totals), control AS (SELECT iter, CASE WHEN total >= bar THEN 1.0 ELSE 0.0 END::DOUBLE AS control FROM totals, bar
), raw AS (SELECT seat, coalesce(avg(control) FILTER (d_won) - avg(control) FILTER (NOT d_won), 0.0) AS r FROM won JOIN control USING (iter) GROUP BY seat)
SELECT seat, round(r, 6) AS stakes_raw, round(CASE WHEN max(r) OVER () - min(r) OVER () < 1e-12 THEN 0.5 ELSE (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) END, 6) AS stakes_normalized FROM raw""")  # fmt: skip
def q_alg_stakes_mc(spark, d):
    out = simulate.stakes(chamber(spark, d), ITERATIONS, simulate.sigma_for("T-60"), SEED, uncontested_d=3)
    return out.select("seat", F.round("stakes_raw", 6).alias("stakes_raw"), F.round("stakes_normalized", 6).alias("stakes_normalized"))


@query(OUTCOME_SQL + "SELECT CAST(total AS BIGINT) AS total, count(*) AS n FROM totals GROUP BY 1")
def q_alg_seat_histogram(spark, d):
    won = simulate.outcomes(chamber(spark, d), ITERATIONS, simulate.sigma_for("T-60"), SEED)
    return simulate.seat_histogram(simulate.totals(won, ITERATIONS, 3))


@query(OUTCOME_SQL + """, hist AS (SELECT CAST(total AS BIGINT) AS total, count(*) AS n FROM totals GROUP BY 1)
SELECT total, n, round(sum(n) OVER (ORDER BY total DESC) / CAST(sum(n) OVER () AS DOUBLE), 6) AS at_least FROM hist""")
def q_alg_seat_tail(spark, d):
    """The chance of every number of seats or more."""
    won = simulate.outcomes(chamber(spark, d), ITERATIONS, simulate.sigma_for("T-60"), SEED)
    return simulate.tail_chances(simulate.seat_histogram(simulate.totals(won, ITERATIONS, 3))).withColumn("at_least", F.round("at_least", 6))


BOOT_SQL = MATRIX_SQL + LINES_SQL + f""", numbered AS (SELECT *, row_number() OVER (ORDER BY state, district) - 1 AS i, count(*) OVER () AS n FROM dems
), size AS (SELECT max(n) AS n FROM numbered), slots AS (SELECT CAST(r.range AS INT) AS rep, CAST(s.range AS INT) AS slot FROM range({REPS}) r, range(100000) s, size WHERE s.range < n
), drawn AS (SELECT rep, slot, d.* FROM slots, size, numbered d WHERE d.i = CAST(floor({u_sql("boot", "rep", "slot")} * size.n) AS INT))
"""  # fmt: skip


def _boot_share_sql(line: str, out: str) -> str:
    return f"""{out} AS (SELECT rep, {CLOSE_SHARE} AS share FROM (
  SELECT rep, margin_pct, CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 1.0 / count(*) OVER p END AS part FROM (
    SELECT rep, margin_pct, {line} AS w FROM drawn QUALIFY row_number() OVER (PARTITION BY rep ORDER BY {line} DESC, state, district, slot) <= 10) WINDOW p AS (PARTITION BY rep)) GROUP BY rep)"""


def drawn(spark, d, reps: int = REPS):
    return simulate.resampled(saved(dems_1998(spark, d)), reps, SEED, DISTRICT)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


@query(BOOT_SQL + "," + _boot_share_sql("fundraising", "shares") + "SELECT round(quantile_cont(share, 0.025), 4) AS ci_low, round(avg(share), 4) AS mean, round(quantile_cont(share, 0.975), 4) AS ci_high, count(*) AS reps FROM shares")
def q_alg_bootstrap_ci(spark, d):
    out = simulate.interval(simulate.bootstrap_shares(drawn(spark, d), "fundraising", 10, al.is_close("margin_pct")))
    return rounded(out, "ci_low", "mean", "ci_high")


@query(BOOT_SQL + "," + _boot_share_sql("fundraising", "a") + "," + _boot_share_sql("final_ratings", "b") + """SELECT round(quantile_cont(x, 0.025), 4) AS ci_low, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.975), 4) AS ci_high, count(*) AS reps, round(avg(CAST(x > 0 AS INT)), 4) AS p_positive FROM (SELECT a.share - b.share AS x FROM a JOIN b USING (rep))""")
def q_alg_paired_bootstrap(spark, d):
    out = simulate.paired(drawn(spark, d), "fundraising", "final_ratings", 10, al.is_close("margin_pct"))
    return rounded(out, "ci_low", "mean", "ci_high", "p_positive")


# A race has at most 25 copies here: more have a chance below 1e-20, and the uniform ends 1e-10 before 1.
COPIES_SQL = MATRIX_SQL + LINES_SQL + f""", two AS (SELECT * FROM ranked WHERE line <> 'oracle'
), places AS (SELECT state, district, row_number() OVER (ORDER BY min(rk), state, district) - 1 AS place, count(*) OVER () AS n FROM two GROUP BY state, district
), uni AS (SELECT CAST(range AS INT) AS rep, place, n, {u_sql("copies", "range", "place")} AS u FROM range({REPS}), places
), drawn(rep, place, copies, remaining) AS (
  SELECT CAST(range AS INT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), (SELECT max(n) FROM places) FROM range({REPS})
  UNION ALL SELECT rep, place, copies, remaining - copies FROM (
    SELECT d.rep, u.place, d.remaining, CASE WHEN u.place = u.n - 1 THEN d.remaining ELSE CAST(len(list_filter(range(0, least(d.remaining, 25)), lambda k: list_sum(list_transform(range(0, k + 1),
      lambda i: exp(lgamma(d.remaining + 1) - lgamma(i + 1) - lgamma(d.remaining - i + 1) + i * ln(1.0::DOUBLE / (u.n - u.place)) + (d.remaining - i) * ln(1 - 1.0::DOUBLE / (u.n - u.place))))) < u.u)) AS BIGINT) END AS copies
    FROM drawn d JOIN uni u ON u.rep = d.rep AND u.place = d.place + 1)
), runs AS (SELECT line, rep, w, margin_pct, copies, coalesce(sum(copies) OVER (PARTITION BY line, rep ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM two JOIN places USING (state, district) JOIN drawn USING (place)
), taken AS (SELECT *, least(copies, 10 - before) AS k FROM runs WHERE before < 10 AND copies > 0
), shares AS (SELECT line, rep, CASE WHEN sum(k * w) > 0 THEN coalesce(sum(k * w) FILTER (abs(margin_pct) < 0.05), 0) / sum(k * w) ELSE coalesce(sum(k) FILTER (abs(margin_pct) < 0.05), 0) / CAST(sum(k) AS DOUBLE) END AS share FROM taken GROUP BY line, rep)
"""  # fmt: skip
COPIES_SQL = COPIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


def copies(spark, d) -> DataFrame:
    return simulate.resampled_shares(saved(dems_1998(spark, d)), ("fundraising", "final_ratings"), 10, {"close": al.is_close("margin_pct")}, REPS, SEED, DISTRICT)


@query(COPIES_SQL + "SELECT line, round(quantile_cont(share, 0.025), 4) AS ci_low, round(avg(share), 4) AS mean, round(quantile_cont(share, 0.975), 4) AS ci_high, count(*) AS reps FROM shares GROUP BY line")
def q_alg_copies_ci(spark, d):
    """Intervals of both lines from copies a race: no resample is laid out."""
    return rounded(simulate.intervals(copies(spark, d), ["close"]).drop("name"), "ci_low", "mean", "ci_high")


@query(COPIES_SQL + """SELECT round(quantile_cont(x, 0.025), 4) AS ci_low, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.975), 4) AS ci_high, count(*) AS reps, round(avg(CAST(x > 0 AS INT)), 4) AS p_positive
FROM (SELECT a.share - b.share AS x FROM shares a JOIN shares b USING (rep) WHERE a.line = 'fundraising' AND b.line = 'final_ratings')""")
def q_alg_copies_paired(spark, d):
    return rounded(simulate.difference(copies(spark, d), "fundraising", "final_ratings", "close"), "ci_low", "mean", "ci_high", "p_positive")


TOP_SQL = MATRIX_SQL + """, dems AS (SELECT *, (state + district) % 4 = 0 AS pivotal, CAST(20000 + 1000 * district AS DOUBLE) AS viable_floor FROM matrix WHERE party_major = 'D' AND cycle = 1998 AND snapshot = 'T-60'
), top AS (SELECT *, CASE WHEN sum(total_trans) OVER () > 0 THEN total_trans / CAST(sum(total_trans) OVER () AS DOUBLE) ELSE 1.0 / count(*) OVER () END AS part FROM (SELECT * FROM dems ORDER BY total_trans DESC, state, district LIMIT 10))
"""


def _top(spark, d):
    rows = dems_1998(spark, d).withColumns({"pivotal": (F.col("state") + F.col("district")) % 4 == 0, "viable_floor": (20000 + 1000 * F.col("district")).cast("double")})
    return al.allocate(rows, "total_trans", 1.0, 10)


@query(TOP_SQL + "SELECT round(coalesce(coalesce(sum(part) FILTER (pivotal), 0) / sum(part), 0), 4) AS pivotal_share FROM top")
def q_alg_pivotal_share(spark, d):
    return rounded(_top(spark, d).agg(al.dollar_share("allocation", F.col("pivotal")).alias("pivotal_share")), "pivotal_share")


@query(TOP_SQL + "SELECT round(coalesce(coalesce(sum(part) FILTER (total_trans < viable_floor), 0) / sum(part), 0), 4) AS under_floor_share FROM top")
def q_alg_floor_saturation(spark, d):
    return rounded(_top(spark, d).agg(al.dollar_share("allocation", F.col("total_trans") < F.col("viable_floor")).alias("under_floor_share")), "under_floor_share")


#: Fixed coefficients of a floor and of nine planes over (rating, incumbent, index), so that SQL can follow what the models give.
FLOOR = ([12_000.0, 3_000.0, 1.5], -20_000.0)
PLANES = [{"level": q, "weights": [0.05 + 0.01 * q, 0.02, 0.002 - 0.001 * q], "intercept": -0.25 + 0.3 * (q - 0.5)} for q in nx.LEVELS]
_RATING = "coalesce(cook_rating, CASE WHEN cpvi >= 10 THEN 7.0 WHEN cpvi >= 3 THEN 6.0 WHEN cpvi > -3 THEN 4.0 WHEN cpvi > -10 THEN 2.0 ELSE 1.0 END)::DOUBLE"
_XS = "[" + ", ".join(f"({r['weights'][0]!r}::DOUBLE * rating + {r['weights'][1]!r}::DOUBLE * incumbent + {r['weights'][2]!r}::DOUBLE * cpvi + ({r['intercept']!r})::DOUBLE)" for r in PLANES) + "]"
SCORED_SQL = ctes("races") + f""", planes AS (SELECT *, list_sort({_XS}) AS xs, {LEVEL_SQL} AS ys FROM (SELECT *, {_RATING} AS rating FROM races)
), scored AS (SELECT *, greatest({_interp_sql("0.05", "0.0", "1.0")} - ({_interp_sql("-0.05", "0.0", "1.0")}), 0) AS competitiveness FROM planes
), floors AS (SELECT *, greatest({FLOOR[1]}::DOUBLE + {FLOOR[0][0]}::DOUBLE * opp_raised_log + {FLOOR[0][1]}::DOUBLE * ie_against_log + {FLOOR[0][2]}::DOUBLE * acs_median_income, 1) AS viable_floor FROM scored
), needed AS (SELECT *, least(greatest((viable_floor - total_trans) / viable_floor, 0), 1) AS need_raw FROM floors
), combined AS (SELECT *, least(greatest(competitiveness * (1 + 0.3::DOUBLE * need_raw), 0), 1) AS impact, total_trans < viable_floor AS under_floor FROM needed)
"""


def _scored(spark, d) -> DataFrame:
    return models.score_quantiles(models.predict_quantiles(st.races(spark, d), PLANES, "naive+pvi"))


@query(SCORED_SQL + "SELECT cycle, district, round(xs[1], 6) AS lowest, round(xs[5], 6) AS median, round(xs[9], 6) AS highest, round(competitiveness, 6) AS competitiveness FROM combined")
def q_alg_quantile_scores(spark, d):
    """What fixed planes predict, and the chance of a close race that follows."""
    at = lambda i, n: F.round(F.get("quantiles", F.lit(i)), 6).alias(n)
    return _scored(spark, d).select("cycle", "district", at(0, "lowest"), at(4, "median"), at(8, "highest"), F.round("competitiveness", 6).alias("competitiveness"))


@query(SCORED_SQL + "SELECT cycle, district, round(viable_floor, 4) AS viable_floor, round(need_raw, 6) AS need_raw, round(impact, 6) AS impact, under_floor FROM combined")
def q_alg_combine_need(spark, d):
    rows = bt.combine_need(_scored(spark, d), FLOOR, 0.3, base="competitiveness")
    return rows.select("cycle", "district", F.round("viable_floor", 4).alias("viable_floor"), F.round("need_raw", 6).alias("need_raw"), F.round("impact", 6).alias("impact"), "under_floor")


@query(SCORED_SQL + """, dems AS (SELECT state, district, margin_pct, competitiveness AS model, CAST(total_trans AS DOUBLE) AS fundraising, CASE WHEN abs(margin_pct) < 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS oracle,
  CASE WHEN cook_rating IS NULL THEN 0.0 ELSE greatest(4 - abs(cook_rating - 4), 1.0) END::DOUBLE AS final_ratings FROM combined WHERE cycle = 2000
), long AS (UNPIVOT dems ON model, fundraising, oracle, final_ratings INTO NAME line VALUE w
), ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY w DESC, state, district) AS rk FROM long
), cut AS (SELECT line, n, margin_pct, CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 1.0 / count(*) OVER p END AS part FROM ranked, (VALUES (1), (3), (5), (10), (20), (50)) g(n) WHERE rk <= n WINDOW p AS (PARTITION BY line, n))
SELECT line, n, round(coalesce(sum(part) FILTER (abs(margin_pct) < 0.05), 0) / sum(part), 4) AS close_share FROM cut GROUP BY line, n""")  # fmt: skip
def q_alg_four_lines(spark, d):
    """All four lines, the model's among them, at every N."""
    rows = _scored(spark, d).where("cycle = 2000").withColumn("final_rating", F.col("cook_rating"))
    return bt.shares_at(bt.with_lines(rows))


@query(SCORED_SQL + """, grid AS (SELECT cycle AS fold, alpha, state, district, margin_pct, under_floor, abs(competitiveness - 0.2) > 0.05 AS pivotal, least(greatest(competitiveness * (1 + alpha * need_raw), 0), 1) AS w FROM combined, (SELECT unnest([0.0, 0.1, 0.3, 0.5, 1.0, 2.0, 5.0]::DOUBLE[]) AS alpha)
), top AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY fold, alpha ORDER BY w DESC, state, district) <= 10
), parts AS (SELECT *, CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 1.0 / count(*) OVER p END AS part FROM top WINDOW p AS (PARTITION BY fold, alpha)
), shares AS (SELECT fold, alpha, round(coalesce(sum(part) FILTER (abs(margin_pct) < 0.05), 0) / sum(part), 4) AS close, round(coalesce(sum(part) FILTER (pivotal), 0) / sum(part), 4) AS pivotal, round(coalesce(sum(part) FILTER (under_floor), 0) / sum(part), 4) AS under_floor FROM parts GROUP BY ALL)
SELECT alpha, round(avg(close), 6) AS mean_close_race, round(stddev_pop(close), 6) AS std_close_race, round(avg(pivotal), 6) AS mean_pivotal, round(avg(under_floor), 6) AS mean_floor_sat FROM shares GROUP BY alpha""")  # fmt: skip
def q_alg_alpha_grid(spark, d):
    """Both cycles as folds under fixed coefficients, all alphas in one ranking."""
    rows = bt.with_need(_scored(spark, d), FLOOR).withColumns({"fold": F.col("cycle"), "base": F.col("competitiveness"), "pivotal": F.abs(F.col("competitiveness") - 0.2) > 0.05})
    out = bt.grid_means(bt.grid_shares(rows, bt.ALPHAS, 10))
    return out.select("alpha", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(ctes("contested") + """SELECT state, district, round(margin, 6) AS margin, row_number() OVER (ORDER BY abs(margin), state, district) <= 10 AS pivotal, abs(margin) < 0.05 AS winnable FROM contested WHERE cycle = 1998 AND party_major = 'D' AND margin < 0""")
def q_alg_counterfactual_pivot(spark, d):
    rows = rs.contested(rs.top_of_party(st.results(spark, d).where((F.col("cycle") == 1998) & F.col("party_major").isin("D", "R")), RACE), RACE)
    return rs.counterfactual(rows, 10).select(*DISTRICT, F.round("margin", 6).alias("margin"), "pivotal", "winnable")


COMBINE_SQL = OUTCOME_SQL + f""", scored AS (SELECT vec_id AS seat, greatest({_interp_sql("0.05", "0.0", "1.0")} - ({_interp_sql("-0.05", "0.0", "1.0")}), 0) AS comp FROM (SELECT *, {LEVEL_SQL} AS ys FROM knots)
), control AS (SELECT iter, CASE WHEN total >= (SELECT count(*) // 2 FROM seats) THEN 1.0 ELSE 0.0 END::DOUBLE AS control FROM totals
), raw AS (SELECT seat, coalesce(avg(control) FILTER (d_won) - avg(control) FILTER (NOT d_won), 0.0) AS r FROM won JOIN control USING (iter) GROUP BY seat
), scaled AS (SELECT seat, r, CASE WHEN max(r) OVER () - min(r) OVER () < 1e-12 THEN 0.5 ELSE (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) END AS s FROM raw)
SELECT seat, round(sqrt(least(comp, 1) * s), 6) AS base, abs(r) > 0.05 AS pivotal FROM scaled JOIN scored USING (seat)"""  # fmt: skip


@query(COMBINE_SQL)
def q_alg_stakes_combine(spark, d):
    """A fixed threshold, half of the seats, combined with the chance of a close race."""
    rows = chamber(spark, d)
    stakes = simulate.stakes(rows, ITERATIONS, simulate.sigma_for("T-60"), SEED, uncontested_d=3, threshold=rows.count() // 2)
    scored = knots(spark, d).select(F.col("vec_id").alias("seat"), nx.close_probability(F.col("raw")).alias("competitiveness"))
    return bt.combine_stakes(scored.join(stakes, "seat")).select("seat", F.round("base", 6).alias("base"), "pivotal")


@query(MATRIX_SQL + """, app AS (SELECT *, CASE WHEN cook_rating IS NULL THEN 0.0 ELSE greatest(4 - abs(cook_rating - 4), 1.0) / 4 END::DOUBLE AS impact FROM matrix WHERE party_major = 'D' AND cycle = 1998 AND snapshot = 'T-60'
), cuts AS (SELECT quantile_cont(impact, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM app), fixed AS (SELECT [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[] AS c
), binned AS (SELECT app.*, CAST(least(1 + len(list_filter(c, lambda x: x <= impact)), 10) AS INT) AS impact_decile FROM app, fixed
), top AS (SELECT * FROM binned WHERE impact_decile BETWEEN 3 AND 10 AND state IN (1, 2, 3, 5, 8, 13, 21) ORDER BY impact DESC, state, district LIMIT 10)
SELECT state, district, cand_id, impact_decile, round(500 * impact / sum(impact) OVER (), 4) AS allocation FROM top""")  # fmt: skip
def q_pre_splitter(spark, d):
    rows = matrix(spark, d).where("party_major = 'D' and cycle = 1998").withColumn("impact", nx.tossup_weight(F.col("cook_rating")) / 4)
    app = bt.apply_deciles(rows, "impact", [i / 10 for i in range(1, 10)])
    out = bt.splitter(app, "T-60", 500.0, 10, states=(1, 2, 3, 5, 8, 13, 21), decile_range=(3, 10))
    return out.select(*DISTRICT, "cand_id", "impact_decile", F.round("allocation", 4).alias("allocation"))


@query()
def q_alg_logistic_ro(spark, d):
    rows = st.races(spark, d)
    scored = models.score_logistic(rows.where("cycle = 2000"), *models.fit_logistic(rows.where("cycle < 2000"), "naive+pvi"), "naive+pvi")
    return scored.select("cycle", *DISTRICT, "party_major", "competitiveness")


@query()
def q_alg_multiquantile_ro(spark, d):
    rows = st.races(spark, d)
    fits = models.fit_quantiles(rows.where("cycle < 2000"), "naive+pvi")
    scored = models.score_quantiles(models.predict_quantiles(rows.where("cycle = 2000"), fits, "naive+pvi"))
    return scored.select("cycle", *DISTRICT, "party_major", "quantiles", "competitiveness")


@query()
def q_alg_viable_floor_ro(spark, d):
    rows = st.races(spark, d)
    out = rows.where("cycle = 2000").withColumn("viable_floor", models.floor_of(*models.fit_floor(rows.where("cycle < 2000"))))
    return out.select(*DISTRICT, "total_trans", "viable_floor", nx.need(F.col("total_trans"), F.col("viable_floor")).alias("need"))


#: The older pipeline's boosting, with fewer trees.
BOOSTED = boosting.Settings(trees=3, depth=3, rate=0.3, min_leaf=10, min_split=20)
BOOSTED_FEATURES = ["cpvi", "incumbent", "opp_raised_log", "ie_against_log", "acs_median_income"]


@query()
def q_leg_huber_ro(spark, d):
    """Margins by boosting under Huber's loss, fitted on the earlier cycle."""
    rows = st.races(spark, d)
    model = boosting.fit(rows.where("cycle < 2000"), BOOSTED_FEATURES, "margin_pct", BOOSTED)
    return boosting.predict(rows, model).select("cycle", *DISTRICT, "margin_pct", "prediction")


@query("SELECT window_start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL)")
def q_stm_daily_totals(spark, d):
    """Extension: the streaming plan's aggregation, over the same rows as a batch."""
    from tallygrove.streaming.totals import windowed

    rows = read(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return windowed(rows, "ts", ["event_type"], "cents", "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
