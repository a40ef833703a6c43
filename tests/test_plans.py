import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallygrove.functions.numeric import LEVELS
from tallygrove.plans import backtest as bt
from tallygrove.plans import features, models, quantiles, queries, simulate
from tallygrove.sources import sinks


@pytest.fixture(scope="module")
def matrix(spark):
    """300 districts a cycle, both parties; the rating leans with the margin."""
    rng = np.random.default_rng(7)
    rows = []
    for cycle in (2016, 2022, 2024):
        for i in range(300):
            rating = float(rng.integers(1, 8))
            margin = float(np.clip((rating - 4) * 0.09 + rng.normal(0, 0.05), -0.99, 0.99))
            for party in "DR":
                raised = int(rng.integers(1_000, 3_000_000))
                rows.append((cycle, "T-60", f"S{i // 10:02d}", i % 10, party, "N", rating, int(rng.integers(0, 2)), margin, (margin > 0) == (party == "D"), raised, float(np.log1p(raised)), 5.0, 50_000.0, float(rng.normal())))
    schema = "cycle int, snapshot string, state string, district int, party_major string, last_name string, cook_rating double, incumbent int, margin_pct double, winner boolean, total_trans bigint, opp_raised_log double, ie_against_log double, acs_median_income double, cpvi double"
    return spark.createDataFrame(rows, schema).cache()


@pytest.mark.parametrize(("n", "p", "alpha"), [(640, 1, 0.1), (200, 5, 0.1), (60, 2, 1e-4)])
def test_quantile_fits_are_optimal(n, p, alpha):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, p)) * 2) / 2
    y = np.clip(x @ rng.normal(size=p) * 0.3 + rng.normal(size=n) * 0.3, -1, 1)
    for q in (0.025, 0.25, 0.5, 0.95):
        w, b = quantiles.fit_quantile(x, y, q, alpha)
        own = quantiles.pinball(x, y, q, alpha, w, b)
        for _ in range(500):
            step = 10.0 ** -rng.integers(1, 6)
            assert own <= quantiles.pinball(x, y, q, alpha, w + rng.normal(size=p) * step, b + rng.normal() * step) + 1e-6


def test_feature_ladder():
    sizes = [len(models.feature_columns(n)) for n in ("naive", "naive+pvi", "naive+pvi+demo", "naive+pvi+demo+fund", "naive+pvi+demo+fund+opp", "full")]
    assert sizes == [2, 3, 11, 13, 14, 16]
    with pytest.raises(KeyError):
        models.feature_columns("nope")


def test_backtest(spark, matrix, tmp_path):
    row = bt.run(matrix, (2016, 2022), 2024, "T-60", feature_set="naive+pvi", reps=50, grid=(1, 10, 50))
    at = {(m["line"], m["n"]): m["close_share"] for m in row.metrics}
    assert row.n_rows == 300 and 0 < row.n_close < 300
    assert all(at["oracle", n] >= at[line, n] for line in bt.LINES for n in (1, 10, 50)) and at["oracle", 10] == 1
    assert at["model", 50] > row.n_close / 300
    assert all(lo <= hi for lo, _, hi in row.ci.values())
    bt.append_json(row, str(tmp_path / "log.jsonl"))
    again = spark.read.json(str(tmp_path / "log.jsonl")).first()
    assert again["n_rows"] == 300 and "N= 10" in bt.report(row) and bt.close_share(row, n=10) == at["model", 10]
    assert {r["n"] for r in bt.n_sensitivity(row)} == {1, 10, 50}
    for bad, error in (({"model": "x"}, KeyError), ({"combine": "x"}, ValueError), ({"universe_name": "x"}, ValueError), ({"headline_n": 7}, ValueError), ({"model": "logistic", "combine": "base"}, ValueError)):
        with pytest.raises(error):
            bt.run(matrix, (2016,), 2024, "T-60", feature_set="naive", **bad)


def test_scores_do_not_see_outcomes(matrix):
    fits = models.fit_quantiles(matrix.where("cycle < 2024"), "naive+pvi")
    test = matrix.where("cycle = 2024")
    a = models.score_quantiles(models.predict_quantiles(test, fits, "naive+pvi"))
    b = models.score_quantiles(models.predict_quantiles(test.withColumns({"margin_pct": F.rand(1), "winner": F.lit(True)}), fits, "naive+pvi"))
    key = ["state", "district", "party_major"]
    assert [r["competitiveness"] for r in a.orderBy(*key).collect()] == [r["competitiveness"] for r in b.orderBy(*key).collect()]
    assert a.where("party_major = 'R'").agg(F.max("competitiveness")).first()[0] == 0
    with pytest.raises(ValueError):
        models.fit_quantiles(matrix.limit(5), "naive+pvi")


def test_logistic_gradient_vanishes(matrix):
    train = matrix.where("cycle < 2024")
    w, b = models.fit_logistic(train, "naive")
    rows = models.design(train, "naive").where(models.scorable("naive")).select("features", (F.abs("margin_pct") < 0.05).cast("double").alias("y")).collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows])
    s = quantiles.Scaled(x.mean(0), x.std(0))
    p = 1 / (1 + np.exp(-(x @ np.array(w) + b)))
    assert np.abs(s(x).T @ (p - y) + np.array(w) * s.scale).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_impact_app_and_splitter(matrix):
    app = bt.bake(matrix, (2016, 2022), 2024, ("T-60",), feature_set="naive+pvi", n_iter=200).cache()
    assert app.count() == 300 and app.agg(F.min("impact"), F.max("impact")).first()[0] >= 0
    assert {r[0] for r in app.select("impact_decile").distinct().collect()} <= set(range(1, 11))
    got = bt.splitter(app, "T-60", 100.0, 5, states=("S01", "S02"), decile_range=(1, 10))
    assert got.count() == 5 and got.agg(F.sum("allocation")).first()[0] == pytest.approx(100)
    assert bt.splitter_shares(got).columns == ["close_share", "pivotal_share", "under_floor_share"]


def test_alpha_grid_equals_a_backtest_for_each_alpha(matrix, monkeypatch):
    settings = {"feature_set": "naive+pvi", "n_iter": 100}
    alphas, cycles = (0.0, 0.5, 5.0), (2016, 2022)
    fits = []
    monkeypatch.setattr(models, "fit_quantiles", lambda *a, f=models.fit_quantiles, **k: fits.append(1) or f(*a, **k))
    grid = bt.alpha_grid(matrix, cycles, "T-60", alphas, **settings)
    assert len(fits) == 2 and [r["alpha"] for r in grid] == list(alphas) and all((r["n_folds"], r["failed"]) == (2, 0) for r in grid)
    row = grid[1]
    runs = [bt.run(matrix, tuple(c for c in cycles if c != fold), fold, "T-60", combine="impact", alpha=0.5, reps=2, grid=(10,), **settings) for fold in cycles]
    assert row["mean_close_race"] == pytest.approx(np.mean([bt.close_share(r) for r in runs])) and row["std_close_race"] == pytest.approx(np.std([bt.close_share(r) for r in runs]))
    assert row["mean_pivotal"] == pytest.approx(np.mean([r.shares["pivotal"][0] for r in runs])) and row["mean_floor_sat"] == pytest.approx(np.mean([r.shares["under_floor"][0] for r in runs]))
    few = bt.alpha_grid(matrix.where("cycle <> 2016 or district = 0 and state = 'S01'"), cycles, "T-60", (0.3,), **settings)
    assert few[0]["n_folds"] + few[0]["failed"] == 2 and few[0]["failed"] == 1


def test_calibration_tables(spark, matrix, tmp_path):
    settings = {"feature_set": "naive+pvi", "n_iter": 50}
    tables = bt.calibrate(matrix, (2016, 2022), 2024, "T-60", alphas=(0.0, 1.0), reps=5, grid=(1, 10), **settings)
    sinks.write_calibration(tables, str(tmp_path / "out"))
    read = lambda name: [r.asDict() for r in spark.read.csv(str(tmp_path / "out" / name), header=True, inferSchema=True).collect()]
    summary = spark.read.json(str(tmp_path / "out" / "summary")).first()
    grid, by_n, cut = read("alpha_grid"), read("n_sensitivity"), read("cycle_ablation")
    assert [r["alpha"] for r in grid] == [0.0, 1.0] and summary["best_alpha"] == bt.best_alpha(grid) and summary["train_cycles"] == [2016, 2022]
    assert [r["n"] for r in by_n] == [1, 10] and by_n[1]["oracle"] == 1
    assert [(r["label"], str(r["train_cycles"])) for r in cut] == [("with_2016", "2016,2022"), ("without_2016", "2022")]
    alone = bt.run(matrix, (2022,), 2024, "T-60", combine="impact", alpha=summary["best_alpha"], reps=2, grid=(10,), **settings)
    assert cut[0]["close_race"] == by_n[1]["model"] and cut[1]["close_race"] == bt.close_share(alone) and cut[1]["pivotal"] == alone.shares["pivotal"][0]
    with pytest.raises(ValueError):
        bt.calibrate(matrix, (2016,), 2024, "T-60")


def test_best_alpha():
    rows = [{"alpha": 0.1, "mean_close_race": 0.5}, {"alpha": 0.0, "mean_close_race": 0.5}, {"alpha": 1.0, "mean_close_race": None}]
    assert bt.best_alpha(rows) == 0.0 and bt.best_alpha([{"alpha": 1.0, "mean_close_race": float("nan")}]) == bt.DEFAULT_ALPHA


def test_stakes(spark):
    rng = np.random.default_rng(1)
    seats = [(i, sorted((c + rng.normal(0, 0.03, 9)).tolist())) for i, c in enumerate([0.0] * 12 + [0.6] * 5 + [-0.6] * 5)]
    df = spark.createDataFrame(seats, "seat int, quantiles array<double>")
    out = {r["seat"]: r for r in simulate.stakes(df, 400, 0.03, 1, uncontested_d=2).collect()}
    assert max(out[i]["stakes_raw"] for i in range(12)) > out[12]["stakes_raw"] == 0
    assert all(0 <= r["stakes_normalized"] <= 1 for r in out.values())
    again = {r["seat"]: r for r in simulate.stakes(df.repartition(5), 400, 0.03, 1, uncontested_d=2).collect()}
    assert again == out and len(LEVELS) == 9


def test_invariants_and_leaks(spark, sf_dir):
    assert all(r["n"] == 0 for r in queries.q_chk_invariants(spark, sf_dir).collect())
    rows = [(2014, "2014-09-05", "wikipedia", True, "2020-01-01"), (2014, "2014-09-05", "wikipedia", False, "2014-01-01"), (2024, "2024-09-06", "wikipedia", False, "2024-09-07"), (2016, "2016-09-09", "wayback_cook", False, "2016-10-09"), (2016, "2016-09-09", "wayback_cook", False, "2016-10-10")]
    df = spark.createDataFrame(rows, "cycle int, snapshot_date string, ratings_source string, leaky_ratings boolean, ratings_day string").withColumns({c: F.col(c).cast("date") for c in ("snapshot_date", "ratings_day")})
    assert sorted(r["rule"] for r in features.leaks(df).collect()) == ["after_snapshot", "archive_too_late", "backfilled_not_flagged"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["cand_id", "state", "district", "total_trans", "margin", "is_close", "allocation"]


def test_stream(spark, sf_dir, tmp_path):
    from tallygrove.streaming import totals

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = totals.stream(spark, str(tmp_path / "in"), "ts timestamp, event_type string, cents bigint", "ts", ["event_type"], "cents").writeStream.outputMode("complete").format("memory").queryName("totals").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = totals.windowed(rows, "ts", ["event_type"], "cents", "1 day")
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, want.collect()))
