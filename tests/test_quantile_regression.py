import numpy as np
import pytest

from tallygrove.functions.numeric import LEVELS
from tallygrove.plans import quantiles


def frame(spark, x, y, parts=6):
    return spark.createDataFrame([(r, float(v)) for r, v in zip(x.tolist(), y, strict=True)], "features array<double>, y double").repartition(parts)


def holds(x, y, w, b, q, alpha, spread):
    """Subgradient conditions over all rows: with what rows on the plane may add, no coordinate's interval leaves out 0."""
    one, size, r = np.hstack([x, np.ones((len(x), 1))]), len(x), y - x @ w - b
    on = np.abs(r) <= 1e-6 * spread
    fixed = -(np.where(r > 0, q, q - 1)[~on] @ one[~on]) / size
    low = np.minimum(-q * one[on], (1 - q) * one[on]).sum(0) / size
    high = np.maximum(-q * one[on], (1 - q) * one[on]).sum(0) / size
    penalty = [(-alpha, alpha) if abs(v) < 1e-9 else (alpha * np.sign(v),) * 2 for v in w] + [(0.0, 0.0)]
    return all(f + lo + p[0] <= 1e-7 and f + hi + p[1] >= -1e-7 for f, lo, hi, p in zip(fixed, low, high, penalty, strict=True))


@pytest.mark.parametrize(("n", "near", "alpha"), [(300, quantiles.NEAR, 0.1), (6000, 300, 0.05)])
def test_planes_are_optimal_for_all_rows(spark, monkeypatch, n, near, alpha):
    monkeypatch.setattr(quantiles, "NEAR", near)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [0, 5, 0, 0]
    x[:, 3] = 7  # a feature without spread
    y = 0.3 * x[:, 0] - 0.02 * x[:, 1] + rng.standard_t(3, n) * (0.2 + 0.1 * np.abs(x[:, 0]))
    scaled = (x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0))
    fits = quantiles.fit(frame(spark, x, y), 4, LEVELS, alpha, 20)
    assert [f["level"] for f in fits] == list(LEVELS)
    for f in fits:
        w, b = np.array(f["weights"]) * np.where(x.std(0) < 1e-9, 1, x.std(0)), f["intercept"] + float(np.array(f["weights"]) @ x.mean(0))
        assert holds(scaled, y, w, b, f["level"], alpha, y.std()), f
        own = quantiles.pinball(scaled, y, f["level"], alpha, w, b)
        assert own <= quantiles.pinball(scaled, y, f["level"], alpha, *quantiles.fit_quantile(scaled, y, f["level"], alpha)) + 1e-7


@pytest.mark.parametrize("alpha", [0.1, 1e-4, 0.0])
def test_small_programs_reach_a_vertex(alpha):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(500, 4))
        x[:, 3] = 0
        y = 0.3 * x[:, 0] - 0.2 * x[:, 1] + rng.standard_t(3, 500) * (0.2 + 0.1 * np.abs(x[:, 0]))
        weight = rng.integers(1, 5, 500)
        for q in (0.025, 0.5, 0.95):
            assert holds(x, y, *quantiles.fit_quantile(x, y, q, alpha), q, alpha, y.std())
            many, values = np.repeat(x, weight, 0), np.repeat(y, weight)
            own, best = (quantiles.pinball(many, values, q, alpha, *fit) for fit in (quantiles.fit_quantile(x, y, q, alpha, weight.astype(float)), quantiles.fit_quantile(many, values, q, alpha)))
            assert own <= best + 1e-7


def test_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "NEAR", 100)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (3000, 2)).astype(float)
    y = np.where(rng.random(3000) < 0.6, 0.25, rng.integers(-2, 3, 3000) / 4)
    scaled = (x - x.mean(0)) / x.std(0)
    for f in quantiles.fit(frame(spark, x, y), 2, (0.1, 0.5), 0.01, 20):
        w, b = np.array(f["weights"]) * x.std(0), f["intercept"] + float(np.array(f["weights"]) @ x.mean(0))
        best = quantiles.pinball(scaled, y, f["level"], 0.01, *quantiles.fit_quantile(scaled, y, f["level"], 0.01))
        assert quantiles.pinball(scaled, y, f["level"], 0.01, w, b) <= best + 1e-6


def test_too_few_rows(spark):
    x = np.arange(10.0)[:, None]
    with pytest.raises(ValueError, match="10 rows"):
        quantiles.fit(frame(spark, x, x[:, 0]), 1, (0.5,), 0.1, 20)
    with pytest.raises(ValueError, match="0 rows"):
        quantiles.fit(frame(spark, x, x[:, 0]).limit(0), 1, (0.5,), 0.1, 20)
