"""The driver's queries for sources, sinks and what else files pass through: tables are written as raw files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import dates
from tallygrove.functions import numeric as nx
from tallygrove.functions import text as fx
from tallygrove.operators import legacy
from tallygrove.operators import money as mo
from tallygrove.operators import results as rs
from tallygrove.plans import features as ft
from tallygrove.plans import standin as st
from tallygrove.plans.queries import DISTRICT, MATRIX_SQL, RACE, matrix, query
from tallygrove.plans.standin import ctes, read
from tallygrove.session import scratch
from tallygrove.sources import delimited, html, reader, sinks, staged


def lines(df: DataFrame, path: str, header: str | None = None) -> str:
    """Writes the only column as text, under ``header`` in a file of its own, which sorts first; gives the path."""
    if header is not None:
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)
    df.write.mode("append").text(path)
    return path


@query("""SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (l_orderkey % 17 <> 0) AS n_dated, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1""")
def q_src_bulk_file(spark, d):
    """A headerless bulk file and its header file, at the paths that a cycle's files have; rows with a field too many go."""
    raw = scratch(spark)
    data, header = delimited.bulk_paths(raw, 1998)["indiv"]
    spark.createDataFrame([('"CMTE_ID",FLAG,TRANSACTION_DT,AMOUNT',)], "value string").coalesce(1).write.text(header)
    day = F.when(F.col("l_orderkey") % 17 == 0, "NA").otherwise(F.date_format("l_shipdate", "MMddyyyy"))
    amount = F.format_string("%.2f", "l_extendedprice")
    lines(read(spark, d, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_returnflag", day, amount, F.when(F.col("l_linenumber") == 5, "x")).alias("value")), data)
    rows = delimited.pipe_table(spark, data, delimited.headers(spark, header))
    return rows.groupBy(F.col("FLAG").alias("flag")).agg(F.count("*").alias("n"), F.count(dates.from_mmddyyyy(F.col("TRANSACTION_DT"))).alias("n_dated"), F.sum(F.round(F.col("AMOUNT").cast("decimal(18,2)") * 100).cast("bigint")).alias("cents"))


@query("""SELECT o_custkey AS cand_id, CAST(s // 100 AS BIGINT) AS ie_for_total, CAST(o // 100 AS BIGINT) AS ie_against_total FROM (
  SELECT o_custkey, coalesce(sum(c) FILTER (o_orderstatus = 'F'), 0) AS s, coalesce(sum(c) FILTER (o_orderstatus = 'O'), 0) AS o FROM (
    SELECT o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders WHERE o_orderdate <= DATE '1996-09-06') GROUP BY 1)""")
def q_src_schedule_e(spark, d):
    """Spending with its header in upper case, renamed, dated, cut off and pivoted by its code."""
    path = scratch(spark)
    rows = read(spark, d, "orders")
    code = F.when(F.col("o_orderstatus") == "F", "S").when(F.col("o_orderstatus") == "O", "O").otherwise("?")
    rows.select(F.col("o_custkey").alias("CAND_ID"), F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("EXP_DATE"), F.format_string("%.2f", "o_totalprice").alias("EXP_AMO"), code.alias("SUP_OPP")).write.csv(path, header=True)
    names = {n: n for n in ("cand_id", "exp_date", "exp_amo", "sup_opp")}
    got = delimited.csv_renamed(spark, path, names, list(names)).withColumns({"cents": F.round(F.col("exp_amo").cast("decimal(18,2)") * 100).cast("bigint"), "day": F.try_to_timestamp(F.initcap(F.lower("exp_date")), F.lit("dd-MMM-yyyy")).cast("date")})
    return mo.support_oppose(mo.as_of(got, st.FLAGSHIP_CUTOFF, "day"), ["cand_id"]).select(F.col("cand_id").cast("bigint").alias("cand_id"), "ie_for_total", "ie_against_total")


@query(ctes("results") + "SELECT state, district, last_name, party_major, votes FROM results WHERE cycle = 1998")
def q_src_results_file(spark, d):
    """Rows wrapped in outer quotes, of all years and stages; the general election's are kept and their party labels read."""
    path = scratch(spark)
    names = "year,state,district,office,stage,special,candidate,party,votes"
    rows = st.results(spark, d)
    label = F.when(F.col("party_major") == "D", "Democratic").when(F.col("party_major") == "R", " republican").otherwise("DEM")
    line = lambda *parts: F.concat(F.lit('"'), F.concat_ws(",", *parts), F.lit('"'))
    name = F.concat(F.lit('""'), "last_name", F.lit(', X""'))
    gen = rows.select(line("cycle", "state", "district", F.lit("US House"), F.lit("GEN"), F.lit("FALSE"), name, label, "votes").alias("value"))
    other = rows.where("cycle = 1998").select(F.explode(F.array(*(line("cycle", "state", "district", F.lit(o), F.lit(s), F.lit(x), name, label, "votes") for o, s, x in (("US SENATE", "GEN", "FALSE"), ("US HOUSE", "PRI", "FALSE"), ("US HOUSE", "GEN", "TRUE"))))).alias("value"))
    lines(gen.unionByName(other), path, names)
    got = rs.general(delimited.quoted_rows(spark, path, names.split(",")), 1998)
    return got.select(F.col("state").cast("int").alias("state"), F.col("district").cast("int").alias("district"), F.trim(F.split_part("candidate", F.lit(","), F.lit(1))).alias("last_name"), rs.parties("party").alias("party_major"), F.col("votes").cast("bigint").alias("votes"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, 'OH' AS state, CAST(c_custkey % 16 AS INT) AS district, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN -CAST(c_custkey % 40 AS INT) ELSE CAST(c_custkey % 40 AS INT) END AS cpvi FROM customer WHERE c_custkey % 7 <> 0")
def q_src_index_file(spark, d):
    """An index file whose columns go by other names; places and indexes in several spellings."""
    path, k = scratch(spark), F.col("c_custkey")
    n = (k % 16).cast("string")
    place = F.when(k % 7 == 0, F.concat(F.lit("Mars "), n)).when(k % 16 == 0, "OH-AL").when(k % 2 == 0, F.concat(F.lit("OH-"), F.lpad(n, 2, "0"))).otherwise(F.concat(F.lit("Ohio "), n))
    index = F.when(k % 3 == 0, "EVEN").when(k % 3 == 1, F.concat(F.lit("R+"), k % 40)).otherwise(F.concat(F.lit(" D+"), k % 40))
    read(spark, d, "customer").select(k.alias("Row Number"), place.alias("The Dist"), index.alias("2022 Cook PVI")).write.csv(path, header=True, quoteAll=True, ignoreLeadingWhiteSpace=False)
    rows = delimited.csv_located(spark, path, {"id": ["row"], "place": ["district", "dist"], "index": ["pvi"]})
    rows = rows.select(F.col("id").cast("bigint").alias("id"), fx.district_code(F.col("place")).alias("_d"), fx.signed_index(F.col("index")).alias("cpvi"))
    return rows.where("_d is not null").select("id", F.col("_d.state").alias("state"), F.col("_d.district").alias("district"), "cpvi")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"NAME\", CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS median_age, CASE WHEN c_nationkey < 10 THEN 'S' || c_nationkey END AS state_abbr, CAST(c_custkey % 50 AS INT) AS district, CAST(1998 AS INT) AS cycle FROM customer")
def q_src_survey(spark, d):
    """Survey responses, a file for each state, their columns in another order; numbers that are none are missing."""
    path, k = scratch(spark), F.col("c_custkey")
    value = F.when(k % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    rows = read(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.array(value, k.cast("string"), F.col("c_nationkey").cast("string"), (k % 50).cast("string"))).alias("r"))
    header = F.array(F.array(*map(F.lit, ("B01002_001E", "NAME", "state", "congressional district"))))
    rows.select("c_nationkey", F.to_json(F.concat(header, "r")).alias("value")).write.partitionBy("c_nationkey").text(path)
    out = staged.acs(spark, [f"{path}/*/*.txt"], 1998, {str(i): f"S{i}" for i in range(10)})
    return out.select("NAME", "median_age", "state_abbr", "district", "cycle")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"NAME\", CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS median_age, 'S' || c_nationkey AS state_abbr, CAST(c_custkey % 50 AS INT) AS district, CAST(1998 AS INT) AS cycle FROM customer WHERE c_nationkey IN (3, 7, 12)")
def q_src_survey_reader(spark, d):
    """The same files through the reader, which opens those of three states only."""
    path, k = scratch(spark), F.col("c_custkey")
    value = F.when(k % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    rows = read(spark, d, "customer").groupBy(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("state")).agg(F.collect_list(F.array(value, k.cast("string"), F.col("c_nationkey").cast("string"), (k % 50).cast("string"))).alias("r"))
    header = F.array(F.array(*map(F.lit, ("B01002_001E", "NAME", "state", "congressional district"))))
    rows.select("state", F.to_json(F.concat(header, "r")).alias("value")).write.partitionBy("state").text(path)
    out = reader.survey(spark, path, 1998, {f"{i:02d}": f"S{i}" for i in range(25)}, only=["03", "07", "12"])
    return out.select("NAME", "median_age", "state_abbr", "district", "cycle")


@query("""SELECT page, stamp, html FROM (SELECT strftime(ts, '%Y%m%d') AS page, max(strftime(ts, '%Y%m%d%H%M%S')) AS stamp, count(*) || ' events' AS html FROM events GROUP BY 1) WHERE stamp <= '20240110120000' QUALIFY row_number() OVER (ORDER BY stamp DESC) = 1""")
def q_src_pages_reader(spark, d):
    """A page for each day and a log of their times; as of a time, the reader opens the last page only."""
    path = scratch(spark)
    days = read(spark, d, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("page")).agg(F.max(F.date_format("ts", "yyyyMMddHHmmss")).alias("stamp"), F.concat(F.count("*"), F.lit(" events")).alias("value"))
    days.select(F.to_json(F.struct(F.col("page").alias("rev"), F.col("stamp").alias("ts"))).alias("value")).write.text(f"{path}/log")
    days.select("page", "value").write.option("lineSep", " ").partitionBy("page").text(f"{path}/pages")
    out = reader.pages(spark, path, upto="20240110120000", last=True, log="log", pages="pages/page={page}")
    return out.select("page", "stamp", F.trim("html").alias("html"))


@query("""SELECT max(ts) FILTER (substr(ts, 1, 8) BETWEEN '20240102' AND '20240120') AS ts, CAST(min(abs(DATE '2024-01-15' - day)) AS INT) AS days FROM (SELECT strftime(ts, '%Y%m%d%H%M%S') AS ts, CAST(ts AS DATE) AS day FROM events)""")
def q_src_archive_index(spark, d):
    """The last capture of a range of days, and how near any comes to a given day."""
    index = read(spark, d, "events").select(F.date_format("ts", "yyyyMMddHHmmss").alias("ts"))
    near = index.withColumn("day", F.lit("2024-01-15").cast("date")).agg(F.min(staged.days_off("ts", "day")).alias("days"))
    return staged.latest_stamp(index, "20240120", "20240102").crossJoin(near)  # a row each


@query("""SELECT CAST(c_custkey AS BIGINT) AS id, 'OH' AS state_abbr, CAST(c_custkey % 90 AS INT) AS district, CASE c_custkey % 3 WHEN 1 THEN 5.0 ELSE 3.5 END::DOUBLE AS cook_ordinal, c_name AS incumbent_raw FROM customer WHERE c_custkey % 3 <> 0""")
def q_src_archive_tables(spark, d):
    """Archive pages with a table for each rating; tables under other headings, and rows that name no district, go."""
    k = F.col("c_custkey")
    head = F.when(k % 3 == 0, "Members").when(k % 3 == 1, "Lean Democratic").otherwise("Republican Toss Up")
    page = F.concat(F.lit("<table><tr><th>"), head, F.lit("</th><th>a</th><th>b</th></tr><tr><td>DIST<td>REP<td>PVI</tr><tr><td> OH-"), k % 90, F.lit(" <td>"), "c_name", F.lit("<td>R+1</tr><tr><td>total<td>1<td>2</table>"))
    rows = html.archive_ratings(html.tables(read(spark, d, "customer").select(k.alias("id"), page.alias("html"))))
    return rows.select("id", "state_abbr", "district", "cook_ordinal", "incumbent_raw")


@query(MATRIX_SQL + """SELECT cycle, snapshot, state, district, party_major, cand_id, last_name, votes, round(margin_pct, 6) AS margin_pct, cook_rating, cpvi, incumbent, total_trans, opp_raised, ie_for_total, ie_against_total,
  round(ln(1 + total_trans), 6) AS self_raised_log, winner, CASE WHEN cycle = 1996 AND snapshot <> 'T-20' THEN -1 ELSE 1 END AS round FROM matrix""")
def q_snk_matrix(spark, d):
    """The matrix written by cycle and snapshot, checked on the way; a second write replaces only the folders that it brings."""
    path, rows = scratch(spark), matrix(spark, d)
    sinks.write_checked(rows.withColumn("round", F.when(F.col("cycle") == 1996, -1).otherwise(1)), path)
    sinks.write_checked(rows.where("cycle = 1996 and snapshot = 'T-20'").withColumn("round", F.lit(1)), path)
    out = staged.processed(spark, path)
    keep = ("cycle", "snapshot", *DISTRICT, "party_major", "cand_id", "last_name", "votes", "margin_pct", "cook_rating", "cpvi", "incumbent", "total_trans", "opp_raised", "ie_for_total", "ie_against_total", "self_raised_log", "winner", "round")
    return out.withColumns({c: F.round(c, 6) for c in ("margin_pct", "self_raised_log")}).select(*keep)


@query("SELECT c_mktsegment AS segment, count(*) AS n, 4 * CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def q_snk_formats(spark, d):
    """Parquet, CSV and JSON lines (twice, as a log grows), written and read."""
    path, rows = scratch(spark), read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    sinks.write_parquet(rows, f"{path}/p")
    sinks.write_csv(rows, f"{path}/c")
    for _ in range(2):
        sinks.append_json(rows.orderBy("c_custkey"), f"{path}/j")
    read_back = [spark.read.parquet(f"{path}/p"), staged.csv(spark, f"{path}/c"), staged.json_lines(spark, f"{path}/j", "c_custkey bigint, c_mktsegment string")]
    got = [r.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum("c_custkey").cast("bigint").alias("total")) for r in read_back]
    sums = got[0].unionByName(got[1]).unionByName(got[2])
    return sums.groupBy("segment").agg(F.min("n").alias("n"), F.sum("total").alias("total"))


@query("SELECT c_custkey AS id, 0::DOUBLE AS a, coalesce(b, 0) AS b FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS b FROM customer)")
def q_src_or_empty(spark, d):
    """A source that is not there is an empty table; what it would have brought is filled with 0 (and other gaps too)."""
    gone = delimited.or_empty(lambda: spark.read.parquet(f"{d}/no_such_table.parquet"), "id bigint, a double", spark)
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("b"))
    return nx.filled(rows.join(gone, "id", "left"), ["a", "b"]).select("id", "a", "b")


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'D' WHEN 2 THEN 'R' WHEN 3 THEN 'D' END AS party, CASE c_custkey % 6 WHEN 0 THEN 'D' WHEN 2 THEN 'R' END AS party_of_results FROM customer""")
def q_str_party_label(spark, d):
    """Labels of candidate files and of results files, where fewer count."""
    label = F.element_at(F.array(*map(F.lit, (" Democratic", "dem", "Republican ", "DEM", "Green", ""))), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), label.alias("label"))
    return rows.select("id", fx.party_major(F.col("label")).alias("party"), rs.parties("label").alias("party_of_results"))


@query("""SELECT c_custkey AS id, c_nationkey || '-' || lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') || ' ' || c_name || ' (decile ' || (1 + c_custkey % 10) || ')' AS label FROM customer""")
def q_str_candidate_label(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("id"), fx.candidate_label(F.col("c_nationkey").cast("string"), k % 40, F.col("c_name"), 1 + k % 10).alias("label"))


@query("""SELECT name, forecaster, count(*) AS n FROM (SELECT lower(replace(event_type, ' ', '_')) || '_' || day AS name, CASE k WHEN 0 THEN 'cook' WHEN 1 THEN 'inside' WHEN 2 THEN 'five38' ELSE 'rcp' END AS forecaster FROM (
  SELECT CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Cook' WHEN 1 THEN 'IE' WHEN 2 THEN '538' ELSE 'Race to the WH' END AS event_type, CAST(event_id % 4 AS INT) AS k, day(ts) AS day FROM events)) GROUP BY ALL""")
def q_str_header_names(spark, d):
    """Headers of two levels, with days and footnotes, as column names, and the forecasters that those name: the different ones are few."""
    who = F.element_at(F.array(*map(F.lit, ("Cook", "IE", "538", "Race to the WH"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read(spark, d, "events").groupBy(F.concat(who, F.lit("[3]: "), F.dayofmonth("ts").cast("string"), F.lit(".")).alias("header")).agg(F.count("*").alias("n"))
    named = [(h, fx.header_name("Ratings", h), fx.forecaster_name(fx.header_name("Ratings", h))) for (h,) in rows.select("header").collect()]  # 4 names on 31 days at most
    return rows.join(spark.createDataFrame(named, "header string, name string, forecaster string"), "header").groupBy("name", "forecaster").agg(F.sum("n").alias("n"))


@query("""SELECT c_custkey AS id, coalesce(rating, CASE WHEN inc = 1 AND party = 'D' THEN 7 WHEN inc = 1 AND party = 'R' THEN 1 WHEN inc = 0 AND margin > 0.1 THEN 7 WHEN inc = 0 AND margin > 0 THEN 6 WHEN inc = 0 AND margin < -0.1 THEN 1 WHEN inc = 0 AND margin < 0 THEN 2 END, 4)::DOUBLE AS rating FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 3.5 END AS rating, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS inc, CASE WHEN c_nationkey % 2 = 0 THEN 'D' ELSE 'R' END AS party, c_acctbal / 10000.0 AS margin FROM customer)""")
def q_imp_legacy_rating(spark, d):
    k = F.col("c_custkey")
    rating = nx.legacy_rating(F.when(k % 5 == 0, 3.5), F.when(k % 3 == 0, 1), F.when(F.col("c_nationkey") % 2 == 0, "D").otherwise("R"), F.col("c_acctbal") / 10000.0)
    return read(spark, d, "customer").select(k.alias("id"), rating.alias("rating"))


@query(ctes("topped", "ratings", "money") + """, survey AS (SELECT n_nationkey AS state, CAST(r.range AS INT) AS district, CAST(30 + n_nationkey AS DOUBLE) AS median_age, CAST(n_nationkey * 1000 + r.range AS DOUBLE) AS median_income FROM nation, range(10) r WHERE n_nationkey % 3 <> 0
), joined AS (SELECT t.*, m.snapshot, m.total_trans, s.median_age, s.median_income FROM topped t JOIN money m USING (cycle, cand_id) LEFT JOIN survey s USING (state, district) WHERE t.margin BETWEEN -0.999999 AND 0.999999)
SELECT cycle, snapshot, state, district, party_major, median_age AS acs_median_age, median_income AS acs_median_income FROM joined QUALIFY count(DISTINCT party_major) OVER (PARTITION BY cycle, snapshot, state, district) = 2""")
def q_join_demographics(spark, d):
    """The matrix with survey columns, which get their prefix; districts without a survey have none."""
    g = st.ratings(spark, d)
    rated = g.crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in st.ELECTIONS], "cycle int")))  # three cycles
    n = F.col("n_nationkey")
    survey = read(spark, d, "nation").where(n % 3 != 0).select(n.alias("state"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("district"), (30 + n).cast("double").alias("median_age"))
    survey = survey.withColumn("median_income", (F.col("state") * 1000 + F.col("district")).cast("double"))
    none = spark.createDataFrame([], "cycle int, snapshot string, cand_id bigint")
    out = ft.build(st.results(spark, d), rated, rated.select("cycle", *DISTRICT, "cpvi"), survey, st.money(spark, d), none)
    return out.select("cycle", "snapshot", *DISTRICT, "party_major", "acs_median_age", "acs_median_income")


@query(ctes("results") + """, view AS (SELECT cycle, state, district, CASE WHEN bool_or(party_major = 'D') AND bool_or(party_major = 'R') THEN 'contested' WHEN bool_or(party_major = 'D') THEN 'd_lock' WHEN bool_or(party_major = 'R') THEN 'r_lock' ELSE 'other_lock' END AS status,
  arg_max(coalesce(party_major, 'OTHER'), (votes, -cand_id)) AS winner FROM results GROUP BY ALL)
SELECT status, count(*) AS n, count(*) FILTER (winner = 'D') AS n_d FROM view GROUP BY 1""")
def q_agg_chamber_counts(spark, d):
    return rs.chamber_counts(rs.chamber(st.results(spark, d), RACE))


@query("""SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, CAST(sum(o_custkey * 1000) AS BIGINT) AS votes, count(x) AS n_x FROM (
  SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS x FROM orders) WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def q_leg_old_votes(spark, d):
    """Vote files of several years that do not have the same columns; counts with thousands marked; two parties only."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey"), F.year("o_orderdate").cast("int").alias("year"), F.format_number(F.col("o_custkey") * 1000, 0).alias("vote_count"), F.when(F.col("o_orderstatus") == "F", "DEM").when(F.col("o_orderstatus") == "O", "REP").otherwise("GRN").alias("party"))
    out = legacy.old_votes([rows.where("o_orderkey % 2 = 0").withColumn("x", F.lit(1)), rows.where("o_orderkey % 2 <> 0")])
    return out.groupBy("year").agg(F.count("*").alias("n"), F.sum("vote_count").alias("votes"), F.count("x").alias("n_x"))


@query("""SELECT o.o_orderkey AS id, l.n AS money, c.c_acctbal AS spending, n.n_name AS survey FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_orderkey LEFT JOIN nation n ON n.n_nationkey = o.o_custkey % 30""")
def q_leg_four_sources(spark, d):
    votes = read(spark, d, "orders").select((F.col("o_custkey") % 30).cast("bigint").alias("place"), F.col("o_orderkey").cast("bigint").alias("id"))
    keyed = votes.select("place", "id")
    money = keyed.join(read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").cast("bigint").alias("id")).agg(F.count("*").alias("money")), "id")
    spent = keyed.join(read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_acctbal").alias("spending")), "id")
    survey = read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("place"), F.col("n_name").alias("survey"))
    return legacy.four_sources(votes, money, spent, survey, ["place"], ["id"]).select("id", "money", "spending", "survey")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE CAST(c_custkey % 50 AS INT) END AS district, 'Ohio' AS state FROM customer")
def q_leg_index_parts(spark, d):
    k = F.col("c_custkey")
    place = F.concat(F.lit("Congressional District "), F.when(k % 5 == 0, "(at Large)").otherwise((k % 50).cast("string")), F.lit(" (115th Congress), Ohio"))
    return read(spark, d, "customer").select(k.cast("bigint").alias("id"), place.alias("p")).select("id", *legacy.index_parts("p"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(lower(p_type), 'brushed|steel')")
def q_cen_search(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.upper("p_type").alias("label"))
    return legacy.search_variables(rows, "brushed|steel").select("id", "name")


@query("SELECT n_regionkey AS region, n_nationkey AS state, n_name AS \"NAME\", n_nationkey * 2 AS x FROM nation")
def q_cen_geography_first(spark, d):
    n = read(spark, d, "nation").select((F.col("n_nationkey") * 2).alias("x"), F.col("n_name").alias("NAME"), F.col("n_nationkey").alias("state"), F.col("n_regionkey").alias("region"))
    return legacy.geography_first(n, ["region", "state"])
