"""Shares of dollars at every N, from the heads of the lines."""

import numpy as np
import pytest

from tallygrove.plans import backtest as bt
from tallygrove.session import saved


@pytest.mark.parametrize("size", [700, 4])
def test_lines_are_cut_from_their_heads(spark, size):
    rng, grid, lines = np.random.default_rng(2), (1, 3, 50), ("a", "b", "none")
    some = lambda: None if rng.random() < 0.1 else float(rng.integers(-3, 9))  # noqa: E731  ties, negative and missing scores
    rows = [(f"S{i % 7}", i, None if i % 13 == 0 else float(rng.normal(0, 0.08)), some(), some(), 0.0) for i in range(size)]
    df = saved(spark.createDataFrame(rows, "state string, district int, margin_pct double, a double, b double, none double").repartition(3))
    out = bt.shares_at(df, grid, lines)
    got = {(r["line"], r["n"]): r["close_share"] for r in out.collect()}
    assert len(got) == len(grid) * len(lines)
    for at, line in enumerate(lines):
        weight = lambda r, at=at: max(r[3 + at] or 0.0, 0.0)
        order = sorted(rows, key=lambda r: (-weight(r), r[0], r[1]))  # noqa: B023
        for n in grid:
            top = [(weight(r), r[2] is not None and abs(r[2]) < 0.05) for r in order[:n]]
            total = sum(w for w, _ in top)
            want = sum(w for w, hit in top if hit) / total if total else sum(hit for _, hit in top) / len(top)
            assert got[line, n] == pytest.approx(want, abs=6e-5)
    # What windows and sums read is the heads, however many rows there are.
    assert spark.read.parquet(*out.inputFiles()).count() == len(lines) * min(size, max(grid))
