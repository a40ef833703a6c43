"""Ordinary least squares with standard errors, for any number of groups in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT = "term string, estimate double, std_error double, t double, n bigint, r2 double"


def least_squares(df: DataFrame, y: str, xs: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by, term (``intercept`` and each of ``xs``), estimate, std_error, t, n, r2.

    The normal equations are made of centred moments, which Spark merges without loss by cancellation, so a group is one row
    of numbers wherever its rows lie. Rows that miss a value (null, NaN) don't count. Where the regressors depend on each other
    or rows are too few for them, estimates are null; without a degree of freedom left, errors are.
    """
    p = len(xs)
    cells = {f"_{i}": F.col(c).cast("double") for i, c in enumerate([*xs, y])}
    rows = df.select(*by, *(c.alias(n) for n, c in cells.items())).where(" and ".join(f"{n} is not null and not isnan({n})" for n in cells))
    means = [F.avg(f"_{i}") for i in range(p + 1)]
    moments = [F.covar_pop(f"_{i}", f"_{j}") for i in range(p + 1) for j in range(p + 1)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.array(*means).alias("_means"), F.array(*moments).alias("_moments")).where("_n > 0")

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                n, mean, c = r["_n"], np.array(r["_means"]), np.array(r["_moments"]).reshape(p + 1, p + 1)
                estimate, error, r2 = np.full(p + 1, np.nan), np.full(p + 1, np.nan), np.nan
                scale = np.sqrt(np.diag(c)[:p])
                if n > p and (scale > 0).all():
                    alike = c[:p, :p] / np.outer(scale, scale)
                    if p == 0 or np.linalg.cond(alike) < 1e12:
                        inverse = np.linalg.inv(alike) / np.outer(scale, scale)
                        slopes = inverse @ c[:p, p]
                        estimate = np.append(mean[p] - mean[:p] @ slopes, slopes)
                        left = max(c[p, p] - slopes @ c[:p, p], 0.0)
                        r2 = 1 - left / c[p, p] if c[p, p] > 0 else np.nan
                        if n > p + 1:
                            noise = left / (n - p - 1)
                            error = np.sqrt(noise * np.append(1 + mean[:p] @ inverse @ mean[:p], np.diag(inverse)))
                t = np.divide(estimate, error, out=np.full(p + 1, np.nan), where=error > 0)
                yield pd.DataFrame({**{k: [r[k]] * (p + 1) for k in by}, "term": ["intercept", *xs], "estimate": estimate, "std_error": error, "t": t, "n": n, "r2": r2})

    schema = T.StructType([*(df.schema[k] for k in by), *T._parse_datatype_string(FIT).fields])
    out = sums.mapInPandas(solved, schema)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("estimate", "std_error", "t", "r2")})
