import math
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallygrove.functions import dates, numeric, rng, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_district_labels(spark):
    got = col(spark, ["Pennsylvania 8", "California 45", "Alaska at-large", "Puerto Rico 1", "", "nan", "Total", None], text.district_label)
    assert [tuple(x) if x else None for x in got] == [("PA", 8), ("CA", 45), ("AK", 0), None, None, None, None, None]


def test_district_codes(spark):
    got = col(spark, ["AL-01", "CA-45", "PA-8", "AK-AL", "MT-AT-LARGE", "ALABAMA-1", "Pennsylvania 8", "Alaska At-Large", "Mars 1", "AL-x", None], text.district_code)
    assert [tuple(x) if x else None for x in got] == [("AL", 1), ("CA", 45), ("PA", 8), ("AK", 0), ("MT", 0), ("AL", 1), ("PA", 8), ("AK", 0), None, None, None]


def test_signed_indexes(spark):
    assert col(spark, ["R+8", "D+12", "EVEN", "Even", " R+5 ", "New seat", "", None], text.signed_index) == [-8, 12, 0, 0, -5, None, None, None]


def test_ratings(spark):
    labels = ["Solid R", "Likely R", "Lean R", "Tilt R", "Tossup", "Toss-up", "Tilt D", "Lean D", "Likely D", "Solid D", "Safe D", "Tossup (flip)", "Unknown", None]
    assert col(spark, labels, text.rating_ordinal) == [1, 2, 3, 3.5, 4, 4, 4.5, 5, 6, 7, 7, 4, None, None]


def test_names_and_parties(spark):
    assert col(spark, ["SMITH, JOHN", "de la cruz , Ann", None, "Solo"], text.surname) == ["SMITH", "DE LA CRUZ", "", "SOLO"]
    assert col(spark, ["SMITH, JOHN", "Ann B. O'Neil-Lee", "", None], text.surname_any) == ["SMITH", "O'NEIL-LEE", "", ""]
    assert col(spark, ["dem", " DFL ", "Republican", "GREEN", None], text.party_major) == ["D", "D", "R", None, None]
    assert col(spark, ["DEM", "DEMOCRAT"], lambda c: text.party_major(c, text.RESULT_DEMOCRATS, text.RESULT_REPUBLICANS)) == [None, "D"]


def test_headers():
    assert text.header_name("Ratings", "Cook[12] (Sep 6)") == "cook_sep_6" and text.header_name("Race", " ") == "race"
    assert [text.forecaster_name(x) for x in ("cook_september_6_2024", "ie_x", "538_y", "pvi", "incumbent", "other")] == ["cook", "inside", "five38", "cpvi", "incumbent_raw", "other"]


@pytest.mark.parametrize(("cycle", "snapshot", "want"), [(2024, "T-60", date(2024, 9, 6)), (2024, "T-110", date(2024, 7, 18)), (2022, "T-20", date(2022, 10, 19)), (2014, "T-60", date(2014, 9, 5)), (2016, "T-110", date(2016, 7, 21))])
def test_cutoffs(spark, cycle, snapshot, want):
    assert dates.snapshot_date(cycle, snapshot) == want
    assert dates.cutoffs(spark).where((F.col("cycle") == cycle) & (F.col("snapshot") == snapshot)).first()["cutoff"] == want
    assert all(d.weekday() == 1 for d in dates.ELECTIONS.values())


def test_lenient_dates(spark):
    assert col(spark, ["09062024", "9062024", "BADDATE9", "13452024", None], dates.from_mmddyyyy) == [date(2024, 9, 6)] * 2 + [None] * 3
    assert col(spark, ["06-SEP-24", "x", None], dates.from_dd_mon_yy) == [date(2024, 9, 6), None, None]
    assert col(spark, ["20240906123000", "2024-09-06T01:02:03Z", "?"], dates.from_stamp) == [date(2024, 9, 6), date(2024, 9, 6), None]


def test_index_ladder(spark):
    got = col(spark, [15.0, 10.0, 5.0, 3.0, 0.0, -3.0, -5.0, -10.0, -15.0, None], lambda c: numeric.rating_from_index(F.lit(None).cast("double"), c), "double")
    assert got == [7, 7, 6, 6, 4, 2, 2, 1, 1, None]


def test_scores(spark):
    pairs = [(1.0, 1.0, 1), (0.5, 0.5, 0.5), (0.0, 1.0, 0), (0.25, 0.16, 0.2), (None, 1.0, 0), (4.0, 1.0, 1)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a double, b double")
    got = [r["x"] for r in df.select("i", numeric.geometric_mean(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == pytest.approx([w for *_, w in pairs])
    assert col(spark, [4.0, 1.0, 7.0, 3.5, None], numeric.tossup_weight, "double") == [4, 1, 1, 3.5, 0]
    assert col(spark, [None, 0.0, 50.0, 200.0], lambda c: numeric.need(c, F.lit(100.0)), "double") == [1, 1, 0.5, 0]
    assert col(spark, ["12", "x", None], numeric.number) == [12, 0, 0]


def test_interpolation_like_numpy(spark):
    np = pytest.importorskip("numpy")
    xs, ys = [0.0, 1.0, 1.0, 3.0], [0.1, 0.2, 0.4, 0.9]
    at = [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0]
    f = lambda c, **k: numeric.interpolate(F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys)), c, **k)
    assert col(spark, at, f, "double") == pytest.approx(np.interp(at, xs, ys))
    assert col(spark, at, lambda c: f(c, left=F.lit(0.0), right=F.lit(1.0)), "double") == pytest.approx(np.interp(at, xs, ys, left=0, right=1))


def test_bins_put_a_cut_in_the_upper_one(spark):
    cuts = F.array(*(F.lit(i / 10) for i in range(1, 10)))
    assert col(spark, [0.0, 0.1, 0.15, 0.9, 1.0, None], lambda c: numeric.bin_of(c, cuts), "double") == [1, 2, 2, 10, 10, 0]


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    w = Window.partitionBy()
    assert {r["x"] for r in df.select(numeric.min_max(F.col("v"), w).alias("x")).collect()} == {0.5}
    assert {r["x"] for r in df.select(numeric.z_score(F.col("v"), w).alias("x")).collect()} == {0.0}


def test_random_numbers_are_replayable(spark):
    df = spark.range(4000).repartition(7).select("id", rng.uniform(1, "a", F.col("id")).alias("u"), rng.normal(1, "b", F.col("id")).alias("z"), rng.slot(1, "c", F.lit(10), F.col("id")).alias("s"))
    a, b = df.orderBy("id").collect(), df.repartition(2).orderBy("id").collect()
    assert a == b and all(0 < r["u"] < 1 for r in a) and {r["s"] for r in a} == set(range(10))
    mean = sum(r["z"] for r in a) / 4000
    assert abs(mean) < 0.1 and abs(math.sqrt(sum((r["z"] - mean) ** 2 for r in a) / 4000) - 1) < 0.1
