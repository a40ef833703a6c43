"""Top-N allocation of a budget by score, and the shares of dollars that measure it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions import numeric as nx

TIES = ("state", "district")
GRID = (1, 3, 5, 10, 20, 50)


def weights(score: str) -> Column:
    """A score as a weight: missing or negative counts 0."""
    return F.greatest(nx.number(F.col(score)), F.lit(0.0))


def allocate(df: DataFrame, score: str, budget: float, n: int, ties: tuple[str, ...] = TIES, need: str | None = None) -> DataFrame:
    """The ``n`` rows of greatest weight (then by ``ties``) with their part of the budget, equal parts where all weights are 0.

    need: a column of dollars still needed, which caps a weight by its share of all of them.
    """
    missing = {score, *([need] if need else [])} - set(df.columns)
    if missing:
        raise KeyError(f"no column {sorted(missing)}")
    if n <= 0:
        raise ValueError("n must be positive")
    by = [F.desc("_w"), *(t for t in ties if t in df.columns)]
    top = df.withColumn("_w", weights(score)).orderBy(*by).limit(n)
    whole = Window.partitionBy()  # at most n rows
    if need:
        top = top.withColumn("_w", nx.need_cap(F.col("_w"), F.coalesce(need, F.lit(0.0)), F.sum(F.coalesce(need, F.lit(0.0))).over(whole)))
    total = F.sum("_w").over(whole)
    part = F.when(total > 0, F.col("_w") / total).otherwise(1 / F.count("*").over(whole))
    return top.withColumn("allocation", part * budget).drop("_w")


def allocate_by(df: DataFrame, groups: list[str], score: str, n: Column | int, order: list) -> DataFrame:
    """The same within each group at once: weight and part (of 1) of the first ``n`` rows of each."""
    ranked = df.withColumn("_w", weights(score)).withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_w"), *order)))
    top = ranked.where(F.col("_rank") <= n)
    w = Window.partitionBy(*groups)
    total = F.sum("_w").over(w)
    return top.withColumn("part", F.when(total > 0, F.col("_w") / total).otherwise(1 / F.count("*").over(w))).drop("_w")


def dollar_share(dollars: Column | str, hit: Column) -> Column:
    """Aggregate: the share of dollars where ``hit`` holds; 0 where there are none."""
    d = F.col(dollars) if isinstance(dollars, str) else dollars
    total = F.sum(d)
    return F.coalesce(F.when(total > 0, F.coalesce(F.sum(F.when(hit, d)), F.lit(0.0)) / total), F.lit(0.0))


def is_close(margin: str = "margin", within: float = nx.CLOSE) -> Column:
    """Strictly within."""
    return F.coalesce(F.abs(margin) < within, F.lit(False))
