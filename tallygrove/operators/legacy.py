"""Operators of the older, superseded pipeline and of its survey client, kept for those who still run them."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Geography hierarchies and their summary levels; pass more to summary_level() where needed.
SUMMARY_LEVELS = {"us": "010", "region": "020", "division": "030", "state": "040", "state> county": "050", "state> county> county subdivision": "060", "state> county> tract": "140", "state> county> tract> block group": "150", "state> place": "160", "state> congressional district": "500"}


def old_votes(parts: list[DataFrame]) -> DataFrame:
    """Vote files of several years, columns by name, counts made numbers, D and R rows only."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("vote_count", F.regexp_replace(F.col("vote_count").cast("string"), ",", "").try_cast("bigint")).where(F.col("party").isin("DEM", "REP"))


def four_sources(votes: DataFrame, money: DataFrame, spending: DataFrame, survey: DataFrame, keys: list[str], candidate: list[str]) -> DataFrame:
    """Votes with money and spending of the candidate and the survey of the district, the year in every key."""
    return votes.join(money, [*keys, *candidate], "left").join(spending, [*keys, *candidate], "left").join(survey, keys, "left")


def prior_term(rows: DataFrame, keys: list[str], year: str = "year", value: str = "dem", span: int = 2) -> DataFrame:
    """Adds last_term_<value>: the value of the same keys a term ago (several rows there are several here)."""
    before = rows.select(*keys, (F.col(year) + span).alias(year), F.col(value).alias(f"last_term_{value}"))
    return rows.join(before, [*keys, year], "left")


def ratios(df: DataFrame, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """name: (part, whole). Shares, null where the whole is 0."""
    return df.withColumns({name: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for name, (a, b) in parts.items()})


def model_rows(df: DataFrame, columns: list[str], filled: list[str]) -> DataFrame:
    """The model's columns; missing money is 0, rows that miss anything else go."""
    return df.select(*columns).fillna(0, subset=filled).dropna(how="any", subset=columns)


def grid_search(df: DataFrame, features: list[str], label: str, kind: str = "forest", depths: tuple[int, ...] = (3, 5), sizes: tuple[int, ...] = (10, 20), folds: int = 3, seed: int = 1, parallelism: int = 4) -> tuple[CrossValidatorModel, float]:
    """The best of a grid of forests or boosted trees by cross-validated R2. Boosting knows squared and absolute loss; plans.boosting has Huber's."""
    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    if kind == "forest":
        model = RandomForestRegressor(featuresCol="_features", labelCol=label, seed=seed)
        grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.numTrees, list(sizes)).build()
    elif kind == "boosting":
        model = GBTRegressor(featuresCol="_features", labelCol=label, seed=seed)
        grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.maxIter, list(sizes)).build()
    else:
        raise ValueError(f"unknown kind {kind!r}")
    cv = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, metricName="r2"), numFolds=folds, seed=seed, parallelism=parallelism)
    fitted = cv.fit(rows)
    return fitted, max(fitted.avgMetrics)


def index_parts(column: str) -> list[F.Column]:
    """``Congressional District 7 (115th Congress), Ohio`` to district (at large: 0) and state."""
    text = F.col(column)
    number = F.regexp_extract(text, r"District (\d+|\(at Large\))", 1)
    return [F.when(number == "(at Large)", F.lit(0)).otherwise(number.try_cast("int")).alias("district"), F.trim(F.regexp_extract(text, r",([^,]*)$", 1)).alias("state")]


def geography_request(geography: list[tuple[str, str]]) -> dict[str, str]:
    """The request parameters of a geography, outermost first."""
    *outer, inner = [(name.replace(" ", "+"), code) for name, code in geography]
    return {"for": ":".join(inner)} | ({"in": "+".join(":".join(x) for x in outer)} if outer else {})


def summary_level(geography: list[tuple[str, str]], levels: dict[str, str] = SUMMARY_LEVELS) -> str:
    return levels["> ".join(name for name, _ in geography)]


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as whole numbers where all their values are, else as doubles, else as they are: one pass for all columns."""
    fits = df.agg(*(F.coalesce(F.bool_and(F.col(c).isNull() | F.col(c).try_cast(t).isNotNull()), F.lit(False)).alias(f"{c}:{t}") for c in columns for t in ("bigint", "double"))).first()
    kinds = {c: next((t for t in ("bigint", "double") if fits[f"{c}:{t}"]), None) for c in columns}
    return df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if t})


def search_variables(variables: DataFrame, pattern: str, column: str = "label") -> DataFrame:
    """Metadata rows that match a pattern, in any case."""
    return variables.where(F.col(column).rlike(f"(?i){pattern}")).orderBy("name")


def geography_first(df: DataFrame, geography: list[str]) -> DataFrame:
    """Geography columns and NAME before all others; ValueError if one is missing."""
    if missing := [c for c in [*geography, "NAME"] if c not in df.columns]:
        raise ValueError(f"no column {missing}")
    return df.select(*geography, "NAME", *(c for c in df.columns if c not in (*geography, "NAME")))
