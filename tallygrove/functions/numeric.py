"""Numeric expressions: lenient casts, clipping, scaling, interpolation, binning, imputation.

Missing is null, never NaN. ``greatest`` and ``least`` skip nulls, so values are made non-null first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

#: Levels of the quantile models.
LEVELS = (0.025, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.975)
#: A race is close where the margin's size is below this.
CLOSE = 0.05


def number(column: Column, kind: str = "double") -> Column:
    """A number, 0 where it is missing or no number."""
    return F.coalesce(column.try_cast(kind), F.lit(0).cast(kind))


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    out = column if low is None else F.greatest(column, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(column.isNotNull(), out)


def geometric_mean(a: Column, b: Column) -> Column:
    """Square root of the product of two scores in 0 to 1; a missing one counts 0."""
    return F.sqrt(clip(F.coalesce(a, F.lit(0.0)), 0.0, 1.0) * clip(F.coalesce(b, F.lit(0.0)), 0.0, 1.0))


def need(own: Column, floor: Column) -> Column:
    """Share of a viable floor (at least 1) that is missing: 1 without own money."""
    base = F.greatest(F.coalesce(floor, F.lit(1.0)), F.lit(1.0))
    return clip((base - F.coalesce(own, F.lit(0.0))) / base, 0.0, 1.0)


def need_boost(score: Column, gap: Column, alpha: Column | float) -> Column:
    return clip(score * (1 + (alpha if isinstance(alpha, Column) else F.lit(alpha)) * gap), 0.0, 1.0)


def tossup_weight(rating: Column) -> Column:
    """4 for a toss-up down to 1 at both ends; 0 without a rating."""
    return F.when(rating.isNotNull(), F.greatest(4 - F.abs(rating - 4), F.lit(1.0))).otherwise(0.0)


def tossup_distance(rating: Column) -> Column:
    return -F.abs(rating - 4)


def need_cap(weight: Column, remaining: Column, total: Column) -> Column:
    return weight * F.least(F.lit(1.0), remaining / F.greatest(total, F.lit(1.0)))


def min_max(column: Column, over: WindowSpec) -> Column:
    """Scaled to 0 to 1 over the window; 0.5 where all are equal."""
    low, high = F.min(column).over(over), F.max(column).over(over)
    return F.when(high - low < 1e-12, F.lit(0.5)).otherwise((column - low) / (high - low))


def z_score(column: Column, over: WindowSpec) -> Column:
    """By the population's deviation; one of 0 counts 1."""
    deviation = F.stddev_pop(column).over(over)
    return (column - F.avg(column).over(over)) / F.when(deviation == 0, 1.0).otherwise(deviation)


def interpolate(xs: Column, ys: Column, x: Column, left: Column | None = None, right: Column | None = None) -> Column:
    """Piecewise linear through the knots (xs ascending, ys); beyond the ends ``left`` and ``right``, or the end knots' values."""
    k = F.size(F.filter(xs, lambda v: v <= x))
    n = F.size(xs)
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    inside = y0 + (x - x0) * (y1 - y0) / (x1 - x0)
    low = left if left is not None else F.get(ys, F.lit(0))
    high = right if right is not None else F.get(ys, n - 1)
    return F.when(k == 0, low).when((k == n) & (x > F.get(xs, n - 1)), high).when(k == n, F.get(ys, n - 1)).otherwise(inside)


def close_probability(quantiles: Column, levels: tuple[float, ...] = LEVELS, within: float = CLOSE) -> Column:
    """Chance of a margin of at most ``within``, by the distribution that the sorted quantiles outline (0 and 1 beyond them)."""
    xs, ys = F.array_sort(quantiles), F.array(*map(F.lit, levels))
    cdf = [interpolate(xs, ys, F.lit(x), F.lit(0.0), F.lit(1.0)) for x in (within, -within)]
    return F.greatest(cdf[0] - cdf[1], F.lit(0.0))


def crosses(quantiles: Column) -> Column:
    """Whether neighbouring quantiles are out of order."""
    return F.exists(F.sequence(F.lit(1), F.size(quantiles) - 1), lambda i: F.get(quantiles, i) < F.get(quantiles, i - 1))


def bin_of(score: Column, cuts: Column) -> Column:
    """1 and the number of cuts at or below the score, at most 10; 0 without a score."""
    return F.when(score.isNull(), 0).otherwise(F.least(F.size(F.filter(cuts, lambda c: c <= score)) + 1, F.lit(10)))


def rating_from_index(rating: Column, index: Column) -> Column:
    """A missing rating from the signed index: 7, 6, 4, 2, 1 from 10, 3, above -3, above -10, below."""
    return F.coalesce(rating, F.when(index >= 10, 7.0).when(index >= 3, 6.0).when(index > -3, 4.0).when(index > -10, 2.0).when(index.isNotNull(), 1.0))


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing features as 0, before any scaling."""
    return df.fillna(0.0, subset=columns)


def legacy_rating(rating: Column, incumbent: Column, party: Column, margin: Column) -> Column:
    """Legacy: a missing rating from incumbency, for open seats from the race's own outcome. It leaks; never for a model."""
    open_seat = F.when(margin > 0.10, 7.0).when(margin > 0, 6.0).when(margin < -0.10, 1.0).when(margin < 0, 2.0)
    holder = F.coalesce(incumbent, F.lit(0))
    return F.coalesce(rating, F.when((holder == 1) & (party == "D"), 7.0).when((holder == 1) & (party == "R"), 1.0).when(holder == 0, open_seat), F.lit(4.0))
