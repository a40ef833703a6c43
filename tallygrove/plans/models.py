"""Models: feature sets, quantile and logistic regression of races, and the funding floor."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallygrove.functions import numeric as nx
from tallygrove.plans import quantiles

# The feature sets, each with its parent and the columns it adds.
FEATURE_SETS = {
    "naive": (None, ("cook_rating", "incumbent")),
    "naive+pvi": ("naive", ("cpvi",)),
    "naive+pvi+demo": ("naive+pvi", ("acs_median_age", "acs_race_white", "acs_race_black", "acs_race_asian", "acs_edu_bachelors", "acs_edu_grad_degree", "acs_median_income", "acs_below_100pct_fpl")),
    "naive+pvi+demo+fund": ("naive+pvi+demo", ("self_raised_log", "self_raised_pct")),
    "naive+pvi+demo+fund+opp": ("naive+pvi+demo+fund", ("opp_raised_log",)),
    "full": ("naive+pvi+demo+fund+opp", ("ie_for_log", "ie_against_log")),
}


def feature_columns(name: str) -> list[str]:
    """A set's columns, its ancestors' first; KeyError for an unknown set."""
    if name not in FEATURE_SETS:
        raise KeyError(f"unknown feature set {name!r}; known: {sorted(FEATURE_SETS)}")
    parent, own = FEATURE_SETS[name]
    return (feature_columns(parent) if parent else []) + list(own)


def add_feature_set(name: str, columns: tuple[str, ...], parent: str | None = None) -> None:
    """The extension point for further sets."""
    if parent is not None:
        feature_columns(parent)
    FEATURE_SETS[name] = (parent, columns)


def design(df: DataFrame, feature_set: str, out: str = "features") -> DataFrame:
    """Adds the feature array: naive takes the rating's distance from a toss-up, others fill it from the index, then 4; the rest fill with 0."""
    names = feature_columns(feature_set)
    rating = nx.tossup_distance(F.col("cook_rating")) if feature_set == "naive" else F.coalesce(nx.rating_from_index(F.col("cook_rating"), F.col("cpvi")), F.lit(4.0))
    cells = [F.coalesce((rating if n == "cook_rating" else F.col(n)).cast("double"), F.lit(0.0)) for n in names]
    return df.withColumn(out, F.array(*cells))


def scorable(feature_set: str) -> Column:
    """D rows, for the naive set with a rating; all others score 0."""
    dem = F.col("party_major") == "D"
    return F.coalesce(dem & F.col("cook_rating").isNotNull() if feature_set == "naive" else dem, F.lit(False))


def fit_quantiles(train: DataFrame, feature_set: str, target: str = "margin_pct", levels: tuple[float, ...] = nx.LEVELS, alpha: float = 0.1) -> list[Row]:
    """level, weights (for unscaled features) and intercept of each level, over the training rows of D candidates; ValueError under max(20, 2 * features) rows."""
    rows = design(train, feature_set).where(scorable(feature_set) & F.col(target).isNotNull()).select("features", F.col(target).cast("double").alias("y"))
    p = len(feature_columns(feature_set))
    return quantiles.fit(rows, p, levels, alpha, max(20, 2 * p))


def predict_quantiles(df: DataFrame, coefficients: list, feature_set: str, out: str = "quantiles") -> DataFrame:
    """coefficients: rows of fit_quantiles, one a level. Adds the sorted quantiles; null where a row is not scorable."""
    fits = sorted(coefficients, key=lambda r: r["level"])
    dots = [F.aggregate(F.zip_with("_x", F.array(*map(F.lit, r["weights"])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + r["intercept"] for r in fits]
    df = design(df, feature_set, "_x").withColumn("raw_" + out, F.when(scorable(feature_set), F.array(*dots)))
    return df.withColumn(out, F.array_sort("raw_" + out)).drop("_x")


def score_quantiles(df: DataFrame, quantiles: str = "quantiles", out: str = "competitiveness") -> DataFrame:
    return df.withColumn(out, F.when(F.col(quantiles).isNotNull(), nx.close_probability(F.col(quantiles))).otherwise(0.0))


def crossing_rate(df: DataFrame, raw: str = "raw_quantiles") -> DataFrame:
    return df.where(F.col(raw).isNotNull()).agg(F.avg(nx.crosses(F.col(raw)).cast("double")).alias("crossing_rate"))


def fit_logistic(train: DataFrame, feature_set: str, target: str = "margin_pct", c: float = 1.0) -> tuple[list[float], float]:
    """Weights (for unscaled features) and intercept of the close-race model; ValueError without D rows or five close ones."""
    rows = design(train, feature_set).where(scorable(feature_set) & F.col(target).isNotNull()).select("features", (F.abs(target) < nx.CLOSE).cast("double").alias("label"))
    n, hits = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or hits < 5:
        raise ValueError(f"{n} rows with {hits:.0f} close races are too few")
    p = len(feature_columns(feature_set))
    stats = rows.agg(*(f(F.get("features", F.lit(i))).alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean, scale = np.array([stats[f"m{i}"] for i in range(p)]), np.array([stats[f"s{i}"] or 1.0 for i in range(p)])
    cells = [(F.get("features", F.lit(i)) - float(mean[i])) / float(scale[i]) for i in range(p)]
    model = LogisticRegression(maxIter=2000, tol=1e-10, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False).fit(rows.select("label", array_to_vector(F.array(*cells)).alias("features")))
    w = model.coefficients.toArray() / scale
    return w.tolist(), float(model.intercept - (w * mean).sum())


def score_logistic(df: DataFrame, weights: list[float], intercept: float, feature_set: str, out: str = "competitiveness") -> DataFrame:
    dot = F.aggregate(F.zip_with("_x", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + intercept
    return design(df, feature_set, "_x").withColumn(out, F.when(scorable(feature_set), 1 / (1 + F.exp(-dot))).otherwise(0.0)).drop("_x")


FLOOR_FEATURES = ("opp_raised_log", "ie_against_log", "acs_median_income")


def fit_floor(train: DataFrame, alpha: float = 0.1, q: float = 0.25) -> tuple[list[float], float]:
    """Weights and intercept of the funding floor: the lower quartile of what winning D candidates of races within 10 % raised; ValueError under 30."""
    rows = train.where((F.col("party_major") == "D") & F.col("winner") & (F.abs("margin_pct") <= 0.10)).select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FLOOR_FEATURES), F.coalesce(F.col("total_trans").cast("double"), F.lit(0.0)).alias("_y"))

    rows = rows.select(F.array(*FLOOR_FEATURES).alias("features"), F.col("_y").alias("y"))
    (got,) = quantiles.fit(rows, len(FLOOR_FEATURES), (q,), alpha, 30)
    return list(got["weights"]), got["intercept"]


def floor_of(weights: list[float], intercept: float) -> Column:
    """At least 1."""
    dot = F.lit(intercept)
    for c, w in zip(FLOOR_FEATURES, weights, strict=True):
        dot = dot + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
    return F.greatest(dot, F.lit(1.0))
