import json

import pytest

from tallygrove.sources import reader


@pytest.fixture()
def folder(tmp_path):
    for code in ("01", "06", "39"):
        (tmp_path / f"{code}.json").write_text(json.dumps([["congressional district", "NAME", "B01002_001E", "state"], ["1", f"a{code}", "38.5", code], ["ZZ", f"b{code}", "N/A", code], ["2", f"c{code}", None]]))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "notes.txt").write_text("not a state")
    return tmp_path


def opened(df):
    return df.rdd.getNumPartitions()


def test_survey_opens_the_wanted_states_only(spark, folder):
    whole = reader.survey(spark, str(folder), 2022, {"39": "OH"})
    assert whole.count() == 9 and opened(whole) == 3
    rows = {r["NAME"]: (r["median_age"], r["state_fips"], r["state_abbr"], r["district"], r["cycle"]) for r in whole.collect()}
    assert rows["a39"] == (38.5, "39", "OH", 1, 2022) and rows["b01"] == (None, "01", None, None, 2022) and rows["c06"] == (None, "06", None, 2, 2022)
    for only in (["39"], ["01", "39"], []):
        some = reader.survey(spark, "file://" + str(folder), 2022, {}, only)
        assert some.count() == 3 * len(only) and opened(some) == max(1, len(only))
    assert whole.where("state_fips = '39'").unionByName(whole.where("state_fips = '01'")).count() == 6 and whole.count() == 9
    (folder / "06.json").write_text("broken")  # a state that is not wanted is not read
    assert reader.survey(spark, str(folder), 2022, {}, ["39"]).count() == 3
    with pytest.raises(Exception, match="Expecting value"):
        whole.collect()


def test_pages_as_of_a_time(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    log = [(5, "2021-03-02T10:00:00Z"), (3, "2020-09-05T23:59:59Z"), (4, "20200906120000")]
    (tmp_path / "revisions.jsonl").write_text("".join(json.dumps({"rev": r, "ts": t}) + "\n" for r, t in log))
    for r, _ in log:
        (tmp_path / "pages" / f"{r}.html").write_text(f"<p>{r}</p>")
    every = reader.pages(spark, str(tmp_path))
    want = [("3", "20200905235959", "<p>3</p>"), ("4", "20200906120000", "<p>4</p>"), ("5", "20210302100000", "<p>5</p>")]
    assert [tuple(r) for r in every.orderBy("stamp").collect()] == want
    for cutoff, page in (("20200906235959", "4"), ("20200906000000", "3"), ("20300101000000", "5")):
        seen = reader.pages(spark, str(tmp_path), upto=cutoff, last=True)
        assert opened(seen) == 1 and [r["page"] for r in seen.collect()] == [page]
        assert reader.pages(spark, str(tmp_path), upto=cutoff).count() == sum(s <= cutoff for _, s, _ in want) == every.where(every["stamp"] <= cutoff).count()
    assert reader.pages(spark, str(tmp_path), upto="2020", last=True).count() == 0
    assert [r["page"] for r in reader.pages(spark, str(tmp_path), since="20200906000000", upto="20210101000000").collect()] == ["4"]
