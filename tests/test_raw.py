"""Raw files on disk become the matrix."""

import datetime
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallygrove import __main__ as cli
from tallygrove.functions import dates
from tallygrove.plans import features, raw
from tallygrove.sources import sinks

COLUMNS = "CMTE_ID,AMNDT_IND,TRANSACTION_DT,TRANSACTION_AMT"
MONEY = [("C001", "07012024", 100), ("C001", "08152024", 200), ("C002", "09052024", 50), ("C002", "09062024", 25), ("C001", "09102024", 999), ("C003", "10012024", 500), ("C002", "11012024", 777), ("C003", "BADDATE9", 10)]
PEOPLE = [("H1", "SMITH, ANN", "DEM", "H", "OH", "1", "I"), ("H2", "JONES, BOB", "REP", "H", "OH", "1", "C"), ("H3", "SMYTHERS, CAT", "DFL", "H", "OH", "2", "O"), ("H4", "BROWN, DAN", "REP", "H", "OH", "2", ""), ("S1", "SMITH, ANN", "DEM", "S", "OH", "1", "I"), ("H5", "ALONE, EVE", "REP", "H", "OH", "3", "I")]
VOTES = [("1", "SMITH, ANN", "DEMOCRAT", 600), ("1", "JONES, BOB", "REPUBLICAN", 400), ("2", "SMYTHER, CAT", "DEMOCRAT", 300), ("2", "BROWN, DAN", "REPUBLICAN", 700), ("2", "OTHER, X", "GREEN", 50), ("3", "ALONE, EVE", "REPUBLICAN", 900)]


@pytest.fixture()
def files(tmp_path):
    fec = tmp_path / "2024" / "fec"
    fec.mkdir(parents=True)
    (fec / "indiv.txt").write_text("".join(f"{c}|N|{day}|{n}\n" for c, day, n in MONEY))
    (fec / "pas.txt").write_text("C003|N|09012024|40\n")
    (fec / "ccl.txt").write_text("C001|H1\nC002|H2\nC003|H3\n")
    (fec / "cn.txt").write_text("".join("|".join(p) + "\n" for p in PEOPLE))
    for key, names in (("indiv", COLUMNS), ("pas", COLUMNS), ("ccl", "CMTE_ID,CAND_ID"), ("cn", "CAND_ID,CAND_NAME,CAND_PTY_AFFILIATION,CAND_OFFICE,CAND_OFFICE_ST,CAND_OFFICE_DISTRICT,CAND_ICI")):
        (fec / f"{key}_headers.csv").write_text(names + "\n")
    (tmp_path / "2024" / "schedule_e.csv").write_text("CAND_ID,EXP_DATE,EXP_AMO,SUP_OPP\nH1,06-SEP-24,10.50,S\nH1,07-SEP-24,99,S\nH2,01-SEP-24,7,O\n")
    (tmp_path / "2024" / "pvi.csv").write_text("Dist,2024 Cook PVI\nOH-01,D+3\nOhio 2,R+9\n")
    (tmp_path / "2024" / "acs").mkdir()
    (tmp_path / "2024" / "acs" / "39.json").write_text(json.dumps([["NAME", "B01002_001E", "state", "congressional district"], ["a", "38.5", "39", "01"], ["b", "41", "39", "02"]]))
    wiki = "".join(f"<tr><td>Ohio {i}</td><td>Lean D</td><td>A</td></tr>" for i in range(1, 4))
    (tmp_path / "2024" / "T-60").mkdir()
    (tmp_path / "2024" / "T-60" / "ratings.html").write_text(f"<table><tr><th>District</th><th>Cook Sept. 6</th><th>CPVI</th></tr>{wiki}</table>")
    (tmp_path / "2024" / "T-60" / "archive.html").write_text("<table><tr><th>Solid Republican</th><th>b</th><th>c</th></tr><tr><td>DIST</td><td>x</td><td>y</td></tr><tr><td>OH-02</td><td>X</td><td>R+9</td></tr></table>")
    rows = "".join(f'"2024,OH,OHIO,{d},US HOUSE,GEN,FALSE,""{n}"",{p},{v}"\n' for d, n, p, v in VOTES)
    (tmp_path / "results.tab").write_text("year,state_po,state,district,office,stage,special,candidate,party,candidatevotes\n" + rows + '"2022,OH,OHIO,1,US HOUSE,GEN,FALSE,""OLD, X"",DEMOCRAT,5"\n')
    return tmp_path


def test_matrix_of_files(spark, files):
    out = raw.matrix(spark, str(files), 2024, ("T-60",), {"39": "OH"}, revisions={"T-60": (7, "2024-09-05")}, least_rows=2)
    got = {(r["district"], r["party_major"]): r for r in out.collect()}
    assert set(got) == {(1, "D"), (1, "R"), (2, "D"), (2, "R")}  # the third district has one side only
    a, b, c, e = got[1, "D"], got[1, "R"], got[2, "D"], got[2, "R"]
    assert (a["cand_id"], a["total_trans"], a["opp_raised"], a["incumbent"], a["ie_for_total"], a["ie_against_total"]) == ("H1", 300, 75, 1, 10, 0)
    assert (b["cand_id"], b["total_trans"], b["incumbent"], b["ie_against_total"]) == ("H2", 75, 0, 7)
    assert (c["cand_id"], c["total_trans"]) == ("H3", 40) and (e["cand_id"], e["total_trans"]) == ("H4", 0)  # H3 by likeness
    assert a["margin_pct"] == pytest.approx(0.2) and c["margin_pct"] == pytest.approx(-0.4) and a["winner"] and not c["winner"]
    assert (a["cpvi"], c["cpvi"], a["acs_median_age"], c["acs_median_age"]) == (3, -9, 38.5, 41.0)
    assert (a["cook_rating"], a["ratings_source"], c["cook_rating"], c["ratings_source"]) == (5.0, "wikipedia", 5.0, "wikipedia")  # no archive for this cycle
    assert not a["leaky_ratings"] and a["ratings_revision_ts"] == "2024-09-05" and str(a["snapshot_date"]) == "2024-09-06" and a["candidate_name"] == "SMITH, ANN"
    assert {r["n"] for r in features.violations(out, ["cycle", "snapshot", "state", "district"]).collect()} == {0}
    assert features.leaks(out).count() == 0


def test_of_two_records_of_a_name_the_funded_one_counts(spark, files):
    fec = files / "2024" / "fec"
    (fec / "cn.txt").write_text("".join("|".join(p) + "\n" for p in [*PEOPLE, ("H9", "SMITH, ANN", "IND", "H", "oh", "1", "O")]))
    (fec / "ccl.txt").write_text("C001|H9\nC002|H2\nC003|H3\n")
    (files / "2024" / "T-110").mkdir()
    (files / "2024" / "T-110" / "ratings.html").write_text((files / "2024" / "T-60" / "ratings.html").read_text())
    out = raw.matrix(spark, str(files), 2024, ("T-110", "T-60"), {"39": "OH"}, revisions={s: (7, "2024-07-01") for s in ("T-110", "T-60")}, least_rows=2)
    got = {r["snapshot"]: (r["cand_id"], r["total_trans"]) for r in out.where("district = 1 and party_major = 'D'").collect()}
    assert got == {"T-110": ("H9", 100), "T-60": ("H9", 300)}


def test_at_large_candidates_without_a_district(spark, files):
    fec = files / "2024" / "fec"
    fec.joinpath("cn.txt").write_text(fec.joinpath("cn.txt").read_text().replace("|OH|1|", "|oh||"))
    assert {(r["cand_id"], r["state"], r["district"]) for r in raw.candidates(spark, str(files), 2024).where("cand_id in ('H1', 'H2')").collect()} == {("H1", "OH", 0), ("H2", "OH", 0)}


def test_sources_that_may_be_missing(spark, files):
    (files / "2024" / "pvi.csv").unlink()
    out = raw.matrix(spark, str(files), 2024, ("T-60",), least_rows=2).where("district = 1 and party_major = 'D'").first()
    assert (out["ie_for_total"], out["cpvi"], out["cook_rating"]) == (10, None, 5.0)


def test_sources_that_may_not(spark, files):
    path = files / "2024" / "schedule_e.csv"
    path.write_text(path.read_text().replace("EXP_AMO", "AMOUNT"))
    with pytest.raises(KeyError, match="exp_amo"):
        raw.matrix(spark, str(files), 2024, ("T-60",), least_rows=2)
    path.write_text(path.read_text().replace("AMOUNT", "EXP_AMO"))
    (files / "2024" / "acs" / "39.json").unlink()
    with pytest.raises(AnalysisException):
        raw.matrix(spark, str(files), 2024, ("T-60",), least_rows=2).count()


def test_pages_by_their_logs(spark, files):
    """A cycle that was filled back: its first revision, flagged, and the archive's values with the archive's time."""
    day, later = files / "2024", files / "2016"
    day.rename(later)
    text = (files / "results.tab").read_text().replace("2024,", "2016,")
    (files / "results.tab").write_text(text)
    for name in ("fec/indiv.txt", "fec/pas.txt"):
        (later / name).write_text((later / name).read_text().replace("2024", "2016"))
    (later / "schedule_e.csv").write_text((later / "schedule_e.csv").read_text().replace("-24", "-16"))
    (later / "pages").mkdir()
    (later / "T-60" / "ratings.html").rename(later / "pages" / "501.html")
    (later / "revisions.jsonl").write_text('{"rev": 501, "ts": "2021-03-02T10:00:00Z"}\n{"rev": 502, "ts": "2021-04-01T00:00:00Z"}\n')
    (later / "archive").mkdir()
    (later / "T-60" / "archive.html").rename(later / "archive" / "20160903120000.html")
    (later / "archive.jsonl").write_text('{"ts": "20160801000000"}\n{"ts": "20160903120000"}\n{"ts": "20161001000000"}\n')
    out = raw.matrix(spark, str(files), 2016, ("T-60",), {"39": "OH"}, least_rows=2)
    got = {r["district"]: r for r in out.where("party_major = 'D'").collect()}
    a, c = got[1], got[2]
    assert (a["cook_rating"], a["ratings_source"], a["ratings_revision_ts"], a["leaky_ratings"]) == (5.0, "wikipedia", "2021-03-02T10:00:00Z", True)
    assert (c["cook_rating"], c["ratings_source"], c["ratings_revision_ts"], c["leaky_ratings"]) == (1.0, "wayback_cook", "20160903120000", False)
    assert features.leaks(out).count() == 0
    assert features.leaks(out.withColumn("leaky_ratings", ~out["leaky_ratings"])).count() == out.count()
    assert raw.pages(spark, str(files), 2016, ("T-20",), dates.ELECTIONS, {})["T-20"]["archive_ts"] == "20161001000000"


def test_a_bad_matrix_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "matrix")
    good = spark.createDataFrame([(c, s, "OH", 1, p, 0.1, datetime.date(2024, 9, 6), "wikipedia", False, "2024-09-01", c) for c in (2022, 2024) for s in ("T-60", "T-20") for p in "DR"], "cycle int, snapshot string, state string, district int, party_major string, margin_pct double, snapshot_date date, ratings_source string, leaky_ratings boolean, ratings_revision_ts string, v int")
    assert sinks.write_checked(good, path) == {"rows": 8, "margin_range": 0, "district_pairs": 0, "leaks": 0}
    later = good.where("cycle = 2024 and snapshot = 'T-20'").withColumn("v", F.lit(7))
    for bad, rule in ((later.withColumn("margin_pct", F.lit(1.0)), "margin_range"), (later.where("party_major = 'D'"), "district_pairs"), (later.withColumn("ratings_revision_ts", F.lit("2024-10-01")), "leaks")):
        with pytest.raises(ValueError, match=rule):
            sinks.write_checked(bad, path)
        assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2022] * 4 + [2024] * 4
    sinks.write_checked(later, path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [7, 7] + [2022] * 4 + [2024] * 2
    assert not [f for f in os.listdir(path) if f.startswith("_staging")]


def test_commands(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    for command, n in (("fec", 3), ("fec_ie", 2), ("results", 6), ("pvi", 2), ("census", 2)):
        cli.main([command, "--raw", str(files), "--cycle", "2024", "--out", str(tmp_path / command)])
        assert spark.read.parquet(str(tmp_path / command)).count() == n, command
