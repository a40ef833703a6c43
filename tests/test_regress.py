import numpy as np
import pytest

from tallygrove.operators.regress import least_squares


def test_several_regressors_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3)) * [1, 1e-3, 1e4] + [1e6, 0, -5e7]  # far from 0, of different sizes
    y = 3 + x @ [2.0, 500.0, 1e-4] + rng.normal(size=900)
    group = rng.integers(0, 3, 900)
    rows = [(int(g), *map(float, v), float(w)) for g, v, w in zip(group, x, y, strict=True)] + [(0, None, 1.0, 2.0, 3.0), (1, 1.0, 1.0, float("nan"), 3.0), (7, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, y double").repartition(5)
    got = {(r["g"], r["term"]): r for r in least_squares(df, "y", ["a", "b", "c"], ("g",)).collect()}
    assert {g for g, _ in got} == {0, 1, 2}
    for g in range(3):
        own, centre, size = x[group == g], x[group == g].mean(0), x[group == g].std(0)
        one = np.hstack([np.ones((len(own), 1)), (own - centre) / size])
        beta, *_ = np.linalg.lstsq(one, y[group == g] - y[group == g].mean(), rcond=None)
        left = y[group == g] - y[group == g].mean() - one @ beta
        beta[0] += y[group == g].mean()
        cov = np.linalg.inv(one.T @ one) * (left @ left) / (len(own) - 4)
        turn = np.diag([1, *(1 / size)])
        turn[0, 1:] = -centre / size  # back to the intercept at 0
        want, error = turn @ beta, np.sqrt(np.diag(turn @ cov @ turn.T))
        for i, term in enumerate(["intercept", "a", "b", "c"]):
            r = got[g, term]
            assert r["estimate"] == pytest.approx(want[i], rel=1e-6, abs=error[i] * 1e-6) and r["std_error"] == pytest.approx(error[i], rel=1e-6) and r["t"] == pytest.approx(want[i] / error[i], rel=1e-5, abs=1e-6)
            assert r["n"] == len(own) and r["r2"] == pytest.approx(1 - left @ left / ((y[group == g] - y[group == g].mean()) ** 2).sum(), rel=1e-9)


def test_what_cannot_be_told(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0 + i) for i in range(5)], "a double, b double, y double")
    assert {r["estimate"] for r in least_squares(df, "y", ["a", "b"]).collect()} == {None}  # b is twice a
    two = {r["term"]: (r["estimate"], r["std_error"], r["t"]) for r in least_squares(df.limit(2), "y", ["a"]).collect()}
    assert two["a"][0] == pytest.approx(1) and two["a"][1:] == (None, None)
    assert least_squares(df.limit(0), "y", ["a"]).count() == 0
    assert least_squares(df, "y", []).first()["estimate"] == pytest.approx(3)
