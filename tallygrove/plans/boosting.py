"""Gradient boosting of regression trees under Huber's loss, which Spark's own boosting lacks.

Rows are kept as bin numbers. Each task counts its rows and sums their gradients by node, feature and bin, Spark adds these
histograms, and the driver, which sees only as many numbers as nodes x features x bins, picks the splits. The loss's delta is an
exact quantile of the absolute residuals, found anew for every tree, and a leaf's value its exact median residual and the mean of
what is left, clipped at delta. No task holds more than a batch of rows; predictions are written once a tree, so lineage is short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.selection import percentiles
from tallygrove.session import dropped, saved

#: Accuracy of the sketch that proposes a feature's bins; any edges give a right tree over them.
SKETCH = 10_000
#: Splits whose gains differ by less than this part of the best are ties: the first feature and bin win.
TIE = 1e-9


@dataclass(frozen=True)
class Settings:
    """trees, depth, rate: as usual; alpha: the quantile of absolute residuals beyond which the loss is linear."""

    trees: int = 50
    depth: int = 3
    rate: float = 0.1
    alpha: float = 0.9
    min_leaf: int = 1
    min_split: int = 2
    bins: int = 32


@dataclass(frozen=True)
class Model:
    """edges: a feature's ascending cuts. A tree: splits, node to (feature, edge number), and values, leaf to value.

    Node k has the children 2k + 1 (values up to the edge) and 2k + 2; the root is 0.
    """

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    rate: float
    trees: tuple[tuple[dict[int, tuple[int, int]], dict[int, float]], ...]


def leaves(binned: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node in which each row of bin numbers ends."""
    at = np.zeros(len(binned), np.int64)
    for node in sorted(splits):  # a parent's number is below its children's
        feature, edge = splits[node]
        here = at == node
        at[here] = 2 * node + np.where(binned[here, feature] <= edge, 1, 2)
    return at


def gradient(residual: np.ndarray, delta: float) -> np.ndarray:
    return np.clip(residual, -delta, delta)


def best_split(count: np.ndarray, total: np.ndarray, s: Settings) -> tuple[int, int] | None:
    """count, total: a node's histogram, features x bins. The (feature, edge) of the greatest fall in squared error, if any."""
    n, g = count[0].sum(), total[0].sum()
    if n < s.min_split:
        return None
    left_n, left_g = count.cumsum(1)[:, :-1], total.cumsum(1)[:, :-1]
    right_n, right_g = n - left_n, g - left_g
    allowed = (left_n >= max(s.min_leaf, 1)) & (right_n >= max(s.min_leaf, 1))
    gain = np.where(allowed, left_n * right_n / n * (left_g / np.maximum(left_n, 1) - right_g / np.maximum(right_n, 1)) ** 2, 0.0)
    best = gain.max(initial=0.0)
    if best <= 1e-12:
        return None
    at = int(np.argmax(gain.ravel() >= best * (1 - TIE)))
    return at // gain.shape[1], at % gain.shape[1]


def _histograms(rows: DataFrame, splits: dict[int, tuple[int, int]], open_: list[int], delta: float, width: int, bins: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """node to its (count, total), each features x bins; from rows: x (bin numbers), r (residual)."""
    slots, cells = np.full(max(open_) + 1, -1), width * bins
    slots[open_] = np.arange(len(open_))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(len(open_) * cells), np.zeros(len(open_) * cells)
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["x"].to_numpy()).astype(np.int64)
            node = leaves(x, splits)
            inside = node < len(slots)
            slot = np.where(inside, slots[np.where(inside, node, 0)], -1)
            own = slot >= 0
            g = gradient(batch["r"].to_numpy()[own], delta)
            for feature in range(width):
                at = slot[own] * cells + feature * bins + x[own, feature]
                count += np.bincount(at, minlength=len(count))
                total += np.bincount(at, g, minlength=len(total))
        at = np.flatnonzero(count)
        yield pd.DataFrame({"cell": at, "n": count[at].astype(np.int64), "g": total[at]})

    parts = rows.select("x", "r").mapInPandas(counted, "cell bigint, n bigint, g double")
    count, total = np.zeros(len(open_) * cells), np.zeros(len(open_) * cells)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect():  # nodes x features x bins at most
        count[r["cell"]], total[r["cell"]] = r["n"], r["g"]
    shape = (len(open_), width, bins)
    return dict(zip(open_, zip(count.reshape(shape), total.reshape(shape), strict=True), strict=True))


def _with_leaf(rows: DataFrame, splits: dict[int, tuple[int, int]]) -> DataFrame:
    leaf = F.pandas_udf(lambda x: pd.Series(leaves(np.vstack(x.to_numpy()).astype(np.int64), splits)), "long")
    return rows.withColumn("leaf", leaf("x"))


def _binned(x: list[Column], edges: tuple[tuple[float, ...], ...]) -> Column:
    """Bin numbers: how many of a feature's edges lie below its value."""
    def place(v: Column, cuts: tuple[float, ...]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < v)) if cuts else F.lit(0)

    return F.array(*(place(v, cuts) for v, cuts in zip(x, edges, strict=True)))


def _numbers(names: list[str] | tuple[str, ...]) -> list[Column]:
    return [F.col(c).cast("double") for c in names]


def _known(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c)
    return out


def fit(df: DataFrame, features: list[str], label: str, settings: Settings = Settings()) -> Model:
    """Rows that miss a feature or the label (null, NaN) don't count; ValueError if none is left. Infinite labels are not allowed."""
    s, x = settings, _numbers(features)
    y = F.col(label).cast("double")
    known = df.where(_known([*x, y]))
    steps = [i / s.bins for i in range(1, s.bins)]
    found = known.agg(F.count("*").alias("n"), *(F.percentile_approx(v, steps, SKETCH).alias(f"_{i}") for i, v in enumerate(x))).first()
    if not found["n"]:
        raise ValueError("no row with all features and the label")
    edges = tuple(tuple(sorted(set(found[f"_{i}"]))) for i in range(len(x)))
    start = saved(known.select(_binned(x, edges).alias("x"), y.alias("r")))
    base = percentiles(start, "r", [0.5]).first()[0][0]
    rows = saved(start.select("x", (F.col("r") - base).alias("r")))
    dropped(start)
    trees = []
    for _ in range(s.trees):
        delta = percentiles(rows.select(F.abs("r").alias("r")), "r", [s.alpha]).first()[0][0]
        splits: dict[int, tuple[int, int]] = {}
        open_ = [0]
        for _ in range(s.depth):
            nodes = _histograms(rows, splits, open_, delta, len(x), s.bins)
            new = {k: cut for k in open_ if (cut := best_split(*nodes[k], s))}
            splits |= new
            open_ = [child for k in new for child in (2 * k + 1, 2 * k + 2)]
            if not open_:
                break
        placed = saved(_with_leaf(rows, splits))
        medians = percentiles(placed, "r", [0.5], ("leaf",)).select("leaf", F.col("percentiles")[0].alias("median"))
        off = F.col("r") - F.col("median")
        clipped = F.greatest(F.least(off, F.lit(delta)), F.lit(-delta))
        at = placed.join(F.broadcast(medians), "leaf").groupBy("leaf").agg((F.first("median") + F.avg(clipped)).alias("v"))  # 2 ** depth leaves
        values = {r["leaf"]: r["v"] for r in at.collect()}
        trees.append((splits, values))
        table = F.create_map(*(F.lit(v) for leaf, value in sorted(values.items()) for v in (leaf, value)))
        dropped(rows)
        rows = saved(placed.select("x", (F.col("r") - s.rate * table[F.col("leaf")]).alias("r")))
        dropped(placed)
    dropped(rows)
    return Model(tuple(features), edges, base, s.rate, tuple(trees))


def predict(df: DataFrame, model: Model, out: str = "prediction") -> DataFrame:
    """``df`` with the model's prediction; null where a feature is missing."""
    width = len(model.features)

    def summed(x: pd.Series) -> pd.Series:
        binned = np.vstack(x.to_numpy()).astype(np.int64) if len(x) else np.empty((0, width), np.int64)
        total = np.full(len(binned), model.base)
        for splits, values in model.trees:
            at = leaves(binned, splits)
            total += model.rate * np.array([values.get(k, 0.0) for k in range(int(at.max(initial=0)) + 1)])[at]
        return pd.Series(total)

    x = _numbers(model.features)
    return df.withColumn(out, F.when(_known(x), F.pandas_udf(summed, "double")(_binned(x, model.edges))))
