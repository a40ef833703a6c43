"""Resamples as copies a race, against resamples that are laid out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.functions import numeric as nx
from tallygrove.functions import rng
from tallygrove.operators.allocate import is_close
from tallygrove.plans import simulate

LINES = ("a", "b")


def table(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i // 10, i % 10, float(rng.integers(0, 9)), float(rng.normal()), float(rng.normal(0, 0.08)), bool(rng.integers(0, 2))) for i in range(n)]
    return spark.createDataFrame(rows, "state int, district int, a double, b double, margin_pct double, pivotal boolean").repartition(3), rows


def test_binomial_inverts_the_distribution():
    for m in (0, 1, 7, 300):
        for p in (0.003, 0.2, 0.5, 1.0):
            rng = np.random.default_rng(m)
            u = rng.uniform(size=4000)
            k = simulate.binomial(u, np.full(len(u), m), p)
            assert ((0 <= k) & (k <= m)).all() and abs(k.mean() - m * p) <= 5 * np.sqrt(m * p * (1 - p) / len(u)) + 1e-12
            assert (np.diff(k[np.argsort(u)]) >= 0).all()


def test_copies_are_multinomial(spark):
    whole = simulate.multiplicities(spark, 400, 30, 30, 3).toPandas()
    assert set(whole.groupby("rep")["copies"].sum()) == {30}
    by = whole.groupby("place")["copies"].sum() / 400
    assert abs(by - 1).max() < 5 * np.sqrt(1 / 400)
    head = simulate.multiplicities(spark, 400, 30, 7, 3).toPandas()
    key = ["rep", "place", "copies"]
    assert sorted(map(tuple, head[key].to_numpy())) == sorted(map(tuple, whole[whole["place"] < 7][key].to_numpy()))


def brute(rows, counts, line, n, hit):
    """Every copy laid out, in the line's order."""
    at = LINES.index(line) + 2
    weight = lambda r: max(r[at], 0.0)
    top = [r for r in sorted(rows, key=lambda r: (-weight(r), r[0], r[1])) for _ in range(counts.get((r[0], r[1]), 0))][:n]
    total = sum(map(weight, top))
    return sum(weight(r) for r in top if hit(r)) / total if total > 0 else sum(map(hit, top)) / len(top)


@pytest.mark.parametrize(("size", "n", "head"), [(60, 10, None), (60, 10, 1), (6, 10, None), (1, 3, None)])
def test_shares_equal_laid_out_resamples(spark, size, n, head):
    df, rows = table(spark, size)
    hits = {"close": is_close("margin_pct"), "pivotal": F.col("pivotal")}
    got = simulate.resampled_shares(df, LINES, n, hits, 40, 11, ["state", "district"], head).collect()
    assert len(got) == 40 * len(LINES)
    order = {x: sorted(rows, key=lambda r, i=i: (-max(r[i + 2], 0.0), r[0], r[1])) for i, x in enumerate(LINES)}
    best = sorted(rows, key=lambda r: (min(order[x].index(r) for x in LINES), r[0], r[1]))
    counts = {}
    for r in simulate.multiplicities(spark, 40, size, size, 11).collect():
        counts.setdefault(r["rep"], {})[best[r["place"]][:2]] = r["copies"]
    for r in got:
        assert r["close"] == pytest.approx(brute(rows, counts[r["rep"]], r["line"], n, lambda x: abs(x[4]) < 0.05))
        assert r["pivotal"] == pytest.approx(brute(rows, counts[r["rep"]], r["line"], n, lambda x: x[5]))


#: What two seeds of either form differ by at 1,000 resamples: means by 0.01, ends, whose density is low, by 0.08.
MEAN, END = 0.02, 0.1


def test_intervals_agree_with_drawn_rows(spark):
    df, _ = table(spark, 80)
    shares = simulate.resampled_shares(df, LINES, 10, {"close": is_close("margin_pct")}, 1000, 1, ["state", "district"])
    new = {r["line"]: r for r in simulate.intervals(shares, ["close"]).collect()}
    drawn = simulate.resampled(df, 1000, 2, ["state", "district"])
    old = {line: simulate.interval(simulate.bootstrap_shares(drawn, line, 10, is_close("margin_pct"))).first() for line in LINES}
    pairs = [(new[line], old[line]) for line in LINES]
    pairs.append((simulate.difference(shares, "a", "b", "close").first(), simulate.paired(drawn, "a", "b", 10, is_close("margin_pct")).first()))
    for a, b in pairs:
        assert a["mean"] == pytest.approx(b["mean"], abs=MEAN) and a["reps"] == b["reps"] == 1000
        assert a["ci_low"] == pytest.approx(b["ci_low"], abs=END) and a["ci_high"] == pytest.approx(b["ci_high"], abs=END)
    assert pairs[-1][0]["p_positive"] == pytest.approx(pairs[-1][1]["p_positive"], abs=0.06)


def test_no_rows(spark):
    df, _ = table(spark, 3)
    assert simulate.resampled_shares(df.limit(0), LINES, 5, {"close": is_close("margin_pct")}, 10, 1, ["state", "district"]).count() == 0


@pytest.mark.parametrize(("seed", "stream", "n", "last"), [(42, "seat", 10_000, "123456"), (1, "s" * 37, 1200, "é-1"), (1, "s" * 50, 120, "z" * 60), (1, "q", 1, "x"), (7, "shock/a", 20_011, None)])
def test_uniforms_equal_the_expression(spark, seed, stream, n, last):
    numbers = [F.col("id"), *([] if last is None else [F.lit(last)])]
    want = [r["u"] for r in spark.range(n).select("id", rng.uniform(seed, stream, *numbers).alias("u")).orderBy("id").collect()]
    draws = rng.Uniforms(seed, stream, n)
    draws.of("another")
    assert draws.of(last).tolist() == want and len(want) == n


def plain_outcomes(rows, n_iter, sigma, seed):
    """iter, seat: won, lost (False) or unknown (None); a draw at a time."""
    from hashlib import md5
    from math import cos, log, pi, sqrt

    u = lambda *key: (int(md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    out = {}
    for i in range(n_iter):
        shock = sigma * sqrt(-2 * log(u(f"{seed}:shock/a", i))) * cos(2 * pi * u(f"{seed}:shock/b", i))
        for seat, q in rows:
            at, q = u(f"{seed}:seat", i, seat), [*(q or []), *[None] * 9][:9]
            k = sum(x <= at for x in nx.LEVELS)
            low, high = q[max(k - 1, 0)], q[min(k, 8)]
            own = None if low is None or high is None else low if k in (0, 9) else low + (at - nx.LEVELS[k - 1]) / (nx.LEVELS[k] - nx.LEVELS[k - 1]) * (high - low)
            out[i, seat] = None if own is None else own + shock > 0
    return out


def odd_seats():
    draw = np.random.default_rng(3)
    rows = [(i, sorted(draw.normal(0, 0.1, 9).tolist())) for i in range(20)]
    return [*rows, (100, None), (101, [-0.1] * 5 + [0.1, 0.2, None, None]), (102, [-0.1, 0.0, 0.1]), (12345678901, [0.0] * 9)]


@pytest.mark.parametrize("n_iter", [1, 300])
def test_seats_won_equal_single_draws(spark, n_iter):
    rows = odd_seats()
    want = plain_outcomes(rows, n_iter, 0.03, 5)
    won = simulate.outcomes(spark.createDataFrame(rows, "seat bigint, quantiles array<double>"), n_iter, 0.03, 5)
    total = {r["iter"]: r["total"] for r in simulate.totals(won, n_iter, 3).collect()}
    assert total == {i: 3 + sum(want[i, s] is True for s, _ in rows) for i in range(n_iter)}
    histogram = {r["total"]: r["n"] for r in simulate.seat_histogram(simulate.totals(won, n_iter, 3)).collect()}
    assert histogram == {t: list(total.values()).count(t) for t in total.values()}
    assert won.count() == len(rows) and won.where("unknown is not null").count() == 3


def test_no_seats(spark):
    none = spark.createDataFrame([], "seat bigint, quantiles array<double>")
    assert simulate.totals(simulate.outcomes(none, 10, 0.03, 5), 10).count() == 0 and simulate.stakes(none, 10, 0.03, 5).count() == 0


def test_tasks_grow_with_the_draws(spark, monkeypatch):
    monkeypatch.setattr(simulate, "DRAWS_A_TASK", 1000)
    seats = spark.range(300).select(F.col("id").alias("seat"), F.array(*map(F.lit, sorted(nx.LEVELS))).alias("quantiles"))
    by_task = simulate.outcomes(seats, 100, 0.03, 5).groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 20 and max(r["count"] for r in by_task) < 40  # 10 a task on average


@pytest.mark.parametrize("threshold", [None, 12])
def test_stakes_equal_single_draws(spark, threshold):
    rows, n_iter = odd_seats(), 300
    want = plain_outcomes(rows, n_iter, 0.03, 5)
    total = [3 + sum(want[i, s] is True for s, _ in rows) for i in range(n_iter)]
    bar = np.median(total) if threshold is None else threshold
    out = {}
    for s, _ in rows:
        won, lost = ([float(total[i] >= bar) for i in range(n_iter) if want[i, s] is flag] for flag in (True, False))
        out[s] = sum(won) / len(won) - sum(lost) / len(lost) if won and lost else 0.0
    df = spark.createDataFrame(rows, "seat bigint, quantiles array<double>")
    got = {r["seat"]: r for r in simulate.stakes(df, n_iter, 0.03, 5, 3, threshold).collect()}
    assert {s: r["stakes_raw"] for s, r in got.items()} == out and any(out.values())
    low, high = min(out.values()), max(out.values())
    assert {s: r["stakes_normalized"] for s, r in got.items()} == {s: (x - low) / (high - low) for s, x in out.items()}


def test_a_seat_is_one_row_of_bits(spark):
    won = simulate.outcomes(spark.createDataFrame(odd_seats(), "seat bigint, quantiles array<double>"), 300, 0.03, 5)
    assert won.count() == len(odd_seats()) and {r["n"] for r in won.select(F.size("won").alias("n")).collect()} == {5}
