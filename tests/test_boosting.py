"""Huber boosting against a plain NumPy boosting over the same edges."""

import numpy as np
import pytest

from tallygrove.plans import boosting


def plain(x, y, edges, s):
    """Predictions after each tree; every split tried on the rows themselves."""
    f = np.full(len(y), np.median(y))
    out = []
    for _ in range(s.trees):
        r = y - f
        delta = np.quantile(np.abs(r), s.alpha)
        g = np.where(np.abs(r) <= delta, r, delta * np.sign(r))

        def grow(rows, depth, r=r, g=g, delta=delta):
            best = (1e-12, None)
            if depth and len(rows) >= s.min_split:
                whole = ((g[rows] - g[rows].mean()) ** 2).sum()
                for j, cuts in enumerate(edges):
                    for c in cuts:
                        left = x[rows, j] <= c
                        if min(left.sum(), (~left).sum()) >= max(s.min_leaf, 1):
                            fall = whole - sum(((g[rows][m] - g[rows][m].mean()) ** 2).sum() for m in (left, ~left))
                            if fall > best[0] * (1 + 1e-9):
                                best = (fall, left)
            if best[1] is None:
                middle = np.median(r[rows])
                f[rows] += s.rate * (middle + np.mean(np.sign(r[rows] - middle) * np.minimum(np.abs(r[rows] - middle), delta)))
            else:
                grow(rows[best[1]], depth - 1)
                grow(rows[~best[1]], depth - 1)

        grow(np.arange(len(y)), s.depth)
        out.append(f.copy())
    return out


def test_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 4, 500), rng.uniform(size=500)])
    y = np.sin(x[:, 0]) + 0.5 * (x[:, 1] == 2) + rng.normal(0, 0.1, 500)
    y[:25] += rng.choice([-30, 30], 25)  # what Huber's loss is for
    rows = [(i, *map(float, v), float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))]
    holes = [(900, None, 1.0, 0.5, 1.0), (901, 0.0, float("nan"), 0.5, 1.0), (902, 0.0, 1.0, 0.5, None)]
    df = spark.createDataFrame(rows + holes, "i int, a double, b double, c double, y double").repartition(5)
    s = boosting.Settings(trees=3, depth=3, rate=0.5, min_leaf=5, bins=8)
    model = boosting.fit(df, ["a", "b", "c"], "y", s)
    want = plain(x, y, model.edges, s)[-1]
    got = {r["i"]: r["prediction"] for r in boosting.predict(df, model).collect()}
    assert [got[i] for i in range(500)] == pytest.approx(want.tolist(), abs=1e-9)
    assert got[900] is got[901] is None and got[902] is not None
    assert all(len(e) <= 7 for e in model.edges) and len(model.trees) == 3
    clean = slice(25, None)
    assert np.abs(want - y)[clean].mean() < 0.5 * np.abs(np.median(y) - y)[clean].mean()


def test_nothing_to_learn(spark):
    flat = spark.createDataFrame([(1.0, 5.0, "t")] * 9, "a double, y double, text string")
    model = boosting.fit(flat, ["a"], "y", boosting.Settings(trees=1))
    assert {r["prediction"] for r in boosting.predict(flat, model).collect()} == {5.0} and model.trees[0][0] == {}
    assert boosting.predict(flat.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        boosting.fit(flat.limit(0), ["a"], "y")
