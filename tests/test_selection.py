import numpy as np
import pandas as pd
import pytest

from tallygrove.operators import selection
from tallygrove.operators.selection import percentiles

LEVELS = [0.0, 0.025, 0.1, 0.5, 0.77, 0.975, 1.0]


@pytest.mark.parametrize("few", [3, 200, selection.FEW])
def test_equals_sorting_all_values(spark, few):
    rng = np.random.default_rng(1)
    # A value that most rows of a group share, whole numbers with ties, a group of one row, one of none, a null key.
    parts = {"hot": np.where(rng.random(4000) < 0.7, 5.0, rng.normal(5, 2, 4000)), "ties": rng.integers(-3, 4, 3000).astype(float), "one": np.array([2.5]), None: rng.exponential(1e6, 2500), "none": np.array([np.nan, np.nan])}
    rows = pd.DataFrame([(k, v) for k, x in parts.items() for v in x], columns=["k", "x"])
    df = spark.createDataFrame([(k, None if v != v else v) for k, v in rows.itertuples(index=False)], "k string, x double").repartition(5)
    got = {r["k"]: r["q"] for r in percentiles(df, "x", LEVELS, ("k",), "q", few).collect()}
    assert set(got) == set(parts) and got["none"] == [None] * len(LEVELS)
    for k, x in parts.items():
        if k != "none":
            assert got[k] == pytest.approx(np.quantile(x, LEVELS).tolist(), rel=1e-12, abs=1e-12)


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(float(i % 101),) for i in range(3000)] + [(float("nan"),), (None,)], "x double")
    assert percentiles(df, "x", LEVELS, few=10).first()[0] == pytest.approx(np.quantile([i % 101 for i in range(3000)], LEVELS).tolist())
    assert percentiles(df.limit(0), "x", LEVELS).first()[0] == [None] * len(LEVELS)
    assert percentiles(df.limit(0).selectExpr("x", "x as k"), "x", LEVELS, ("k",)).count() == 0


def test_infinite_values(spark):
    x = [float("-inf")] * 3 + list(range(50)) + [float("inf")] * 2
    got = percentiles(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", [0.0, 0.5, 1.0], few=4).first()[0]
    assert got == [float("-inf"), 24.0, float("inf")]


def test_no_state_of_all_values(spark):
    df = spark.range(10).selectExpr("id % 2 as k", "cast(id as double) as x")
    plan = percentiles(df, "x", [0.5], ("k",))._jdf.queryExecution().toString()
    assert "percentile(" not in plan
