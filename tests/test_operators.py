import datetime
import random
import json

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import dates
from tallygrove.operators import allocate as al
from tallygrove.operators import match, money, results
from tallygrove.sources import delimited, html, staged

ROWS = [("C001", "07012024", 100), ("C001", "08152024", 200), ("C002", "09052024", 50), ("C002", "09062024", 25), ("C001", "09102024", 999), ("C003", "10012024", 500), ("C002", "11012024", 777), ("C003", "BADDATE9", 10)]


def test_as_of_keeps_the_boundary(spark):
    df = spark.createDataFrame(ROWS, "cmte_id string, dt string, cents bigint").withColumn("txn_date", dates.from_mmddyyyy(F.col("dt")))
    got = {r["cmte_id"]: r["cents"] for r in money.committee_totals(money.as_of(df, dates.snapshot_date(2024, "T-60")), []).collect()}
    assert got == {"C001": 300, "C002": 75}
    more = money.all_snapshots(df.withColumn("cycle", F.lit(2024)), dates.cutoffs(spark))
    by = {r["snapshot"]: r["s"] for r in more.groupBy("snapshot").agg(F.sum("cents").alias("s")).collect()}
    assert by == {"T-110": 100, "T-60": 375, "T-20": 1874} and by["T-110"] <= by["T-60"] <= by["T-20"]


def test_linked_committees_count_for_each_candidate(spark):
    totals = spark.createDataFrame([("a", 150, 0), ("b", 99, 201)], "cmte_id string, by_indiv bigint, by_cmte bigint")
    link = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("z", "x"), ("a", None)], "cmte_id string, cand_id string")
    got = {r["cand_id"]: tuple(r)[1:] for r in money.candidate_totals(totals, link, []).collect()}
    assert got == {"x": (4, 2, 2), "y": (1, 1, 0)}


def test_support_and_oppose(spark):
    df = spark.createDataFrame([("x", "S", 250), ("x", "O", 199), ("y", "?", 500)], "cand_id string, sup_opp string, cents bigint")
    assert sorted(map(tuple, money.support_oppose(df, ["cand_id"]).collect())) == [("x", 2, 1), ("y", 0, 0)]


RACE = "state string, district int, cand_id int, last_name string, party_major string, votes bigint"


def test_margins_and_chamber(spark):
    df = spark.createDataFrame([("A", 1, 1, "a", "D", 60), ("A", 1, 2, "b", "D", 10), ("A", 1, 3, "c", "R", 40), ("B", 1, 4, "d", "R", 5), ("C", 1, 5, "e", None, 5), ("D", 1, 6, "f", "D", 0)], RACE)
    rows = {r["cand_id"]: r for r in results.margins(df, ["state", "district"]).collect()}
    assert rows[1]["margin"] == pytest.approx(0.2) and rows[1]["winner"] and not rows[2]["winner"] and rows[3]["vote_share"] == pytest.approx(40 / 110)
    assert rows[4]["margin"] == -1 and rows[5]["margin"] is None and rows[6]["vote_share"] is None
    got = {r["state"]: tuple(r)[2:] for r in results.chamber(df, ["state", "district"]).collect()}
    assert got["A"][:2] == ("contested", "D") and got["A"][2] == pytest.approx(70 / 110) and got["B"] == ("r_lock", "R", 0.0) and got["C"] == ("other_lock", "OTHER", None)


def test_contested_pairs(spark):
    rows = [("CA", 45, 1, "a", "D", 50), ("CA", 45, 2, "b", "R", 40), ("WY", 0, 3, "c", "R", 9), ("OH", 1, None, "d", "D", 5), ("OH", 1, 4, "e", "R", 6)]
    df = results.margins(spark.createDataFrame(rows, RACE), ["state", "district"])
    assert {r["cand_id"] for r in results.contested(df, ["state", "district"]).collect()} == {1, 2}


def test_top_of_party_breaks_ties(spark):
    rows = [("A", 1, 2, "b", "D", 5), ("A", 1, 1, "a", "D", 5), ("A", 1, 3, "c", "D", None)]
    for seed in (1, 2):
        df = spark.createDataFrame(rows[::-1] if seed == 1 else rows, RACE)
        assert [r["cand_id"] for r in results.top_of_party(df, ["state", "district"]).collect()] == [1]


def test_running_sums_equal_a_copy_for_each_snapshot(spark):
    days = spark.createDataFrame([(c, f"S{k}", datetime.date(c, 3 + k, 1)) for c in (2020, 2022) for k in range(6)] + [(2022, "same", datetime.date(2022, 5, 1))], "cycle int, snapshot string, cutoff date")
    rng = random.Random(1)
    rows = [(rng.choice([2020, 2022]), rng.choice([None, datetime.date(2022, rng.randint(1, 12), rng.randint(1, 28)), datetime.date(2020, rng.randint(1, 12), 1)]), rng.randint(1, 9), rng.choice(["indiv", "cmte"]), rng.randint(1, 10**9)) for _ in range(900)]
    df = spark.createDataFrame(rows, "cycle int, txn_date date, cmte_id int, source string, cents bigint")
    link = spark.createDataFrame([(c, c % 4) for c in range(1, 9)] + [(3, 0), (4, None)], "cmte_id int, cand_id int")
    parts = {"i": F.col("source") == "indiv", "c": F.col("source") == "cmte"}
    got = {tuple(r) for r in money.as_of_sums(df, days, link, parts).collect()}
    copies = money.all_snapshots(df, days).join(link.where("cand_id is not null"), "cmte_id")
    want = {tuple(r) for r in copies.groupBy("cycle", "snapshot", "cand_id").agg(*(F.coalesce(F.sum(F.when(c, F.col("cents"))), F.lit(0)) for c in parts.values())).collect()}
    assert got == want and len(got) > 30
    seen = money.first_seen(df, days)
    assert seen.count() <= df.where("txn_date is not null").count() and seen.columns == [*df.columns, "_seen"]


def test_fuzzy_matches(spark):
    records = spark.createDataFrame([(1, "A", 1, "GLUESENKAMP PEREZ", "D"), (2, "A", 1, "SMYTHE", "R"), (3, "A", 1, "SMYTHES", "D"), (4, "B", 1, "JONES", "R"), (5, "B", 1, "JONES", "R")], "cand_id int, state string, district int, last_name string, party_major string")
    rows = spark.createDataFrame([(10, "A", 1, "PEREZ", "D"), (11, "A", 1, "SMYTHE", "D"), (12, "A", 1, "SMITH", "R"), (13, "B", 1, "JONES", "D"), (14, "C", 1, "JONES", "D")], "row_id int, state string, district int, last_name string, party_major string")
    got = {r["row_id"]: (r["cand_id"], r["how"]) for r in match.fuzzy(rows, records).collect()}
    assert got == {10: (1, "contained"), 11: (3, "ratio"), 13: (4, "ratio")}


def test_overlay(spark):
    wiki = spark.createDataFrame([("A", 1, 3.0, "x"), ("B", 1, None, "y")], "state string, district int, r double, who string")
    archive = spark.createDataFrame([("A", 1, 4.0), ("C", 1, 5.0)], "state string, district int, r double")
    got = {x["state"]: (x["r"], x["who"], x["ratings_source"]) for x in match.overlay(wiki, archive, ["state", "district"], "r").collect()}
    assert got == {"A": (4.0, "x", "archive"), "B": (None, "y", "wiki"), "C": (5.0, None, "archive")}


def alloc(spark, scores, budget=100.0, n=10, **more):
    rows = [(f"s{i}", i, s, 1000.0 if i else 10.0) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "state string, district int, score double, remaining double")
    return {r["district"]: r["allocation"] for r in al.allocate(df, "score", budget, n, **more).collect()}


def test_allocations(spark):
    assert alloc(spark, [1.0, 3.0]) == {0: 25, 1: 75}
    assert alloc(spark, [0.0, 0.0, 0.0], 99.0, 3) == pytest.approx({0: 33, 1: 33, 2: 33})
    assert alloc(spark, [-5.0, 10.0]) == {0: 0, 1: 100} and alloc(spark, [None, 5.0]) == {0: 0, 1: 100}
    assert set(alloc(spark, [1.0] * 6, n=3)) == {0, 1, 2}
    capped = alloc(spark, [1.0, 1.0], need="remaining")
    assert capped[1] / capped[0] == pytest.approx(100) and sum(capped.values()) == pytest.approx(100)
    with pytest.raises(ValueError):
        alloc(spark, [1.0], n=0)
    with pytest.raises(KeyError):
        al.allocate(spark.range(1), "nope", 1.0, 1)


def test_dollar_shares(spark):
    df = spark.createDataFrame([(30.0, 0.05), (10.0, 0.049), (60.0, None)], "d double, margin double")
    assert df.agg(al.dollar_share("d", al.is_close()).alias("x")).first()["x"] == pytest.approx(0.1)
    assert df.limit(0).agg(al.dollar_share("d", al.is_close()).alias("x")).first()["x"] == 0


def test_pipe_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1|x|NA\n2|y\n3|z|w|extra\n\n")
    (tmp_path / "h.csv").write_text("ID,NAME,CODE\n")
    names = delimited.headers(spark, str(tmp_path / "h.csv"))
    assert sorted(map(tuple, delimited.pipe_table(spark, str(tmp_path / "a.txt"), names).collect())) == [("1", "x", None), ("2", "y", None)]
    assert delimited.bulk_paths("raw", 2024)["ccl"] == ("raw/2024/fec/ccl.txt", "raw/2024/fec/ccl_headers.csv")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("cand_id,exp_amo\nx,5\n")
    assert delimited.csv_renamed(spark, str(tmp_path / "e.csv"), {"cand_id": "CAND_ID", "exp_amo": "EXP_AMO"}, ["CAND_ID"]).columns == ["CAND_ID", "EXP_AMO"]
    with pytest.raises(KeyError):
        delimited.csv_renamed(spark, str(tmp_path / "e.csv"), {"cand_id": "CAND_ID"}, ["SUP_OPP"])
    (tmp_path / "p.csv").write_text("The District,2022 PVI,z\nAL-01,R+5,1\n")
    assert tuple(delimited.csv_located(spark, str(tmp_path / "p.csv"), {"d": ["district"], "i": ["pvi"]}).first()) == ("AL-01", "R+5")
    (tmp_path / "r.tab").write_text('year,state,candidate\n"2022,ALABAMA,""SMITH, A"""\n"2022,OHIO"\n"2022,OHIO,X,Y"\n')
    assert delimited.quoted_rows(spark, str(tmp_path / "r.tab")).count() == 1
    assert tuple(delimited.quoted_rows(spark, str(tmp_path / "r.tab")).first()) == ("2022", "ALABAMA", "SMITH, A")
    assert delimited.or_empty(lambda: spark.read.parquet("/nowhere"), "a int", spark).count() == 0


def test_html_tables(spark):
    page = "<table><tr><th colspan=2>x</th></tr><tr><th>District</th><th>Cook PVI</th><th>Cook (Sep 6)</th><th>Incumbent</th></tr>" + "".join(f"<tr><td>Ohio {i}<td>R+{i}</td><td>Lean R (flip)</td><td>A<br>B</td></tr>" for i in range(1, 60)) + "</table>"
    got = html.ratings(spark, page, 2024, "T-60", 7).orderBy("district").first()
    assert (got["state_abbr"], got["district"], got["cpvi_signed"], got["cook_ordinal"], got["incumbent_raw"], got["flip_predicted"]) == ("OH", 1, -1, 3.0, "A B", True)
    with pytest.raises(ValueError):
        html.ratings(spark, "<table><tr><td>1</table>", 2024, "T-60", 7)
    old = "<table><tr><th>Lean Democratic</th><th>b</th><th>c</th></tr><tr><td>DIST</td><td>REP</td><td>PVI</td></tr><tr><td>NY-19</td><td>X</td><td>D+1</td></tr><tr><td>bad</td><td>X</td><td>D+1</td></tr></table>"
    pages = spark.createDataFrame([(1, old), (2, None)], "page_id int, html string")
    rows = html.archive_ratings(html.tables(pages)).collect()
    assert [tuple(r) for r in rows] == [(1, "NY", 19, 5.0, "Lean Democratic", "X", "D+1")]


def test_staged_sources(spark, tmp_path):
    log = spark.createDataFrame([("p", "2024-09-01 10:00:00", 1), ("p", "2024-09-06 23:59:59", 2), ("p", "2024-09-07 00:00:00", 3), ("q", "2024-12-01 00:00:00", 9)], "page string, ts string, rev int").withColumn("ts", F.col("ts").cast("timestamp"))
    log = log.unionByName(log.where("page = 'q'").withColumn("page", F.lit("s")))
    wanted = spark.createDataFrame([("p", True), ("q", True), ("r", True), ("s", False)], "page string, may_fill boolean").withColumn("cutoff", F.lit("2024-09-06").cast("date"))
    got = {r["page"]: (r["rev"], r["backfilled"]) for r in staged.latest_revision(log, wanted, "page", "ts", "rev").collect()}
    assert got == {"p": (2, False), "q": (9, True), "r": (None, False), "s": (None, False)}
    index = spark.createDataFrame([("20240901000000",), ("20240906235959",), ("20240907000000",), ("20231031000000",)], "ts string")
    assert staged.latest_stamp(index, "20240906", "20231101").first()["ts"] == "20240906235959"
    (tmp_path / "a.json").write_text(json.dumps([["NAME", "B01003_001E", "state", "congressional district"], ["x", "12", "01", "03"], ["y", "n/a", "02", "ZZ"]]))
    a = {r["NAME"]: r for r in staged.acs(spark, [str(tmp_path / "a.json")], 2022, {"01": "AL"}).collect()}
    assert (a["x"]["total_pop"], a["x"]["state_abbr"], a["x"]["district"]) == (12.0, "AL", 3) and a["y"]["total_pop"] is None and a["y"]["district"] is None
    with pytest.raises(FileNotFoundError):
        staged.processed(spark, str(tmp_path / "none"))


def test_downloads(tmp_path):
    src = tmp_path / "s.txt"
    src.write_text("hello")
    dest = str(tmp_path / "d" / "t.txt")
    assert staged.download(src.as_uri(), dest, staged.sha256(str(src))) == dest and staged.sha256(dest) == staged.sha256(str(src))
    with pytest.raises(ValueError):
        staged.download(src.as_uri(), str(tmp_path / "u.txt"), "0" * 64, wait=0)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert staged.retry(flaky, wait=0) == "ok" and len(calls) == 3


def test_sinks(spark, tmp_path):
    from tallygrove.sources import sinks

    df = spark.createDataFrame([(2022, "T-60", 1), (2024, "T-60", 2)], "cycle int, snapshot string, v int")
    path = str(tmp_path / "m")
    sinks.write_matrix(df, path)
    sinks.write_matrix(df.where("cycle = 2024").withColumn("v", F.lit(9)), path)
    assert sorted((r["cycle"], r["v"]) for r in staged.processed(spark, path).collect()) == [(2022, 1), (2024, 9)]
    assert staged.processed(spark, path, 2024, "T-60").count() == 1
    sinks.append_json(df, str(tmp_path / "j"))
    sinks.append_json(df, str(tmp_path / "j"))
    assert staged.json_lines(spark, str(tmp_path / "j")).count() == 4
    sinks.write_csv(df, str(tmp_path / "c"))
    assert dict(staged.csv(spark, str(tmp_path / "c")).dtypes)["v"] == "int"
    cuts = [i / 10 for i in range(1, 10)]
    sinks.write_thresholds(str(tmp_path / "t.json"), cuts, alpha=0.3)
    assert sinks.read_thresholds(str(tmp_path / "t.json")) == cuts
    with pytest.raises(ValueError):
        sinks.write_thresholds(str(tmp_path / "t.json"), cuts[:3])


def test_legacy(spark):
    from tallygrove.operators import legacy

    df = spark.createDataFrame([("1", "1.5", "x"), ("2", None, "3")], "a string, b string, c string")
    assert [k for _, k in legacy.typed(df, ["a", "b", "c"]).dtypes] == ["bigint", "double", "string"]
    assert legacy.geography_request([("state", "06"), ("congressional district", "*")]) == {"for": "congressional+district:*", "in": "state:06"}
    assert legacy.summary_level([("state", "06"), ("county", "*")]) == "050"
    names = spark.createDataFrame([("Congressional District 7 (115th Congress), Ohio",), ("Congressional District (at Large) (115th Congress), Alaska",)], "n string")
    assert [tuple(r) for r in names.select(*legacy.index_parts("n")).collect()] == [(7, "Ohio"), (0, "Alaska")]
    votes = spark.createDataFrame([("1,200", "DEM"), ("x", "REP"), ("5", "GRN")], "vote_count string, party string")
    assert sorted(map(tuple, legacy.old_votes([votes, votes.select("party")]).select("party", "vote_count").collect()), key=repr) == [("DEM", 1200), ("DEM", None), ("REP", None), ("REP", None)]
    rows = spark.createDataFrame([(float(i), float(i % 7), 3.0 * i) for i in range(120)], "x double, z double, y double")
    _, r2 = legacy.grid_search(rows, ["x", "z"], "y", depths=(3,), sizes=(5,), folds=2)
    assert r2 > 0.8
    with pytest.raises(ValueError):
        legacy.geography_first(df, ["state"])
