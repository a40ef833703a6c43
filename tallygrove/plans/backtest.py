"""Backtest, calibration and the app's table: orchestration over the operators. Loops run over settings, never over rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions import numeric as nx
from tallygrove.operators.allocate import GRID, allocate, allocate_by, dollar_share, is_close
from tallygrove.operators.selection import percentiles
from tallygrove.plans import models, simulate
from tallygrove.session import dropped, saved

LINES = ("model", "fundraising", "oracle", "final_ratings")
ALPHAS = (0.0, 0.1, 0.3, 0.5, 1.0, 2.0, 5.0)
#: When every setting's metric is missing.
DEFAULT_ALPHA = 0.3


@dataclass(frozen=True)
class Run:
    """One backtest: settings, shares by line and N, and the intervals at the headline N."""

    feature_set: str
    model: str
    combine: str
    universe: str
    snapshot: str
    train_cycles: tuple[int, ...]
    test_cycle: int
    headline_n: int
    n_rows: int
    n_close: int
    metrics: list[dict] = field(default_factory=list)
    ci: dict = field(default_factory=dict)
    shares: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def universe(df: DataFrame, name: str, feature_set: str) -> DataFrame:
    """D rows: ``wikipedia`` those with a rating, ``all`` all of them (for the naive set those with a rating)."""
    if name not in ("wikipedia", "all"):
        raise ValueError(f"unknown universe {name!r}")
    rated = name == "wikipedia" or feature_set == "naive"
    dems = df.where(F.col("party_major") == "D")
    return dems.where("cook_rating is not null") if rated else dems


def with_lines(df: DataFrame, score: str = "competitiveness", final: str = "final_rating") -> DataFrame:
    """The four scores that are compared."""
    rating = nx.tossup_weight(F.col(final)) if final in df.columns else F.lit(0.0)
    return df.withColumns({"model": F.col(score), "fundraising": F.col("total_trans").cast("double"), "oracle": is_close("margin_pct").cast("double"), "final_ratings": rating})


def with_final_ratings(dems: DataFrame, ratings: DataFrame | None, column: str = "cook_ordinal") -> DataFrame:
    """Adds final_rating, the last one before the election; a district without one, or no ratings at all, weighs nothing."""
    if ratings is None:
        return dems.withColumn("final_rating", F.lit(None).cast("double"))
    last = ratings.groupBy("state", "district").agg(F.max(F.col(column).cast("double")).alias("final_rating"))
    return dems.drop("final_rating").join(last, ["state", "district"], "left")


#: What a share of dollars counts, by its name; each is a flag of the scored rows.
HITS = {"close": "_close", "pivotal": "pivotal", "under_floor": "under_floor"}


def flagged(dems: DataFrame) -> DataFrame:
    """The flags of HITS; those whose model did not run are false."""
    known = {"_close": is_close("margin_pct")} | {c: F.coalesce(F.col(c), F.lit(False)) if c in dems.columns else F.lit(False) for c in ("pivotal", "under_floor")}
    return dems.withColumns(known)


def hit_shares(df: DataFrame, n: int, line: str = "model") -> DataFrame:
    """One row: the share of the line's dollars over the top ``n`` for each of HITS."""
    top = allocate(df, line, 1.0, n)
    return top.agg(*(F.round(dollar_share("allocation", F.col(flag)), 4).alias(name) for name, flag in HITS.items()))


def shares_at(df: DataFrame, grid: tuple[int, ...] = GRID, lines: tuple[str, ...] = LINES) -> DataFrame:
    """line, n, close_share: each line's first rows, as many as the greatest N, cut at each N of the grid. No line is ranked whole."""
    key = ["state", "district"]
    rows = saved(df.select(*key, "margin_pct", *(F.col(x).cast("double").alias(x) for x in lines)))  # read once a line
    top = saved(simulate.heads(rows, lines, {"close": is_close("margin_pct")}, key, max(grid)))
    dropped(rows)
    cut = top.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(n,) for n in grid], "n int"))).where(F.col("_rank") <= F.col("n"))  # a handful of N
    whole = Window.partitionBy("line", "n")  # at most n rows
    total = F.sum("_w").over(whole)
    parts = cut.withColumn("part", F.when(total > 0, F.col("_w") / total).otherwise(1 / F.count("*").over(whole)))
    return parts.groupBy("line", "n").agg(F.round(dollar_share("part", F.col("_close")), 4).alias("close_share"))


def combine_stakes(df: DataFrame, raw: str = "stakes_raw") -> DataFrame:
    return df.withColumns({"base": nx.geometric_mean(F.col("competitiveness"), F.col("stakes_normalized")), "pivotal": F.coalesce(F.abs(raw) > simulate.PIVOTAL, F.lit(False))})


def with_need(df: DataFrame, floor: tuple[list[float], float]) -> DataFrame:
    df = df.withColumn("viable_floor", models.floor_of(*floor)).withColumn("need_raw", nx.need(F.col("total_trans"), F.col("viable_floor")))
    return df.withColumn("under_floor", F.coalesce(F.col("total_trans") < F.col("viable_floor"), F.lit(False)))


def combine_need(df: DataFrame, floor: tuple[list[float], float], alpha: float, base: str = "base") -> DataFrame:
    return with_need(df, floor).withColumn("impact", nx.need_boost(F.col(base), F.col("need_raw"), alpha))


def scored(matrix: DataFrame, train_cycles: tuple[int, ...], test_cycle: int, snapshot: str, feature_set: str = "full", model: str = "multi-quantile", combine: str = "competitiveness", universe_name: str = "all", n_iter: int = 10_000, seed: int = 42, uncontested_d: int = 0) -> DataFrame:
    """The test cycle's D rows under models of the training cycles: competitiveness; for ``base`` also stakes, for ``impact`` also the floor and the need. No alpha yet."""
    at = matrix.where(F.col("snapshot") == snapshot)
    train, test = at.where(F.col("cycle").isin(*train_cycles)), at.where(F.col("cycle") == test_cycle)
    if model == "logistic":
        rows = models.score_logistic(test, *models.fit_logistic(train, feature_set), feature_set)
    else:
        rows = models.score_quantiles(models.predict_quantiles(test, models.fit_quantiles(train, feature_set), feature_set))
    dems = universe(rows, universe_name, feature_set).withColumn("seat", F.concat_ws("-", "state", "district"))
    if combine != "competitiveness":
        dems = combine_stakes(dems.join(simulate.stakes(dems, n_iter, simulate.sigma_for(snapshot), seed, uncontested_d), "seat"))
    return with_need(dems, models.fit_floor(train)) if combine == "impact" else dems


def run(matrix: DataFrame, train_cycles: tuple[int, ...], test_cycle: int, snapshot: str, feature_set: str = "full", model: str = "multi-quantile", combine: str = "competitiveness", universe_name: str = "all", headline_n: int = 10, reps: int = 1000, n_iter: int = 10_000, alpha: float = DEFAULT_ALPHA, seed: int = 42, grid: tuple[int, ...] = GRID, uncontested_d: int = 0, final_ratings: DataFrame | None = None) -> Run:
    """Fits on the training cycles, scores the test cycle, and measures the shares of dollars in close races.

    With stakes or needs among the scores, also the shares in pivotal seats and below the funding floor; all with intervals.
    final_ratings: state, district, cook_ordinal of the last ratings before the election, the fourth line.
    """
    if model not in ("multi-quantile", "logistic"):
        raise KeyError(f"unknown model {model!r}")
    if combine not in ("competitiveness", "base", "impact"):
        raise ValueError(f"unknown combination {combine!r}")
    if combine != "competitiveness" and model != "multi-quantile":
        raise ValueError("stakes need the quantile model")
    if headline_n not in grid:
        raise ValueError("the headline N is not in the grid")
    models.feature_columns(feature_set)
    dems = scored(matrix, train_cycles, test_cycle, snapshot, feature_set, model, combine, universe_name, n_iter, seed, uncontested_d)
    score = combine
    if combine == "impact":
        dems = dems.withColumn("impact", nx.need_boost(F.col("base"), F.col("need_raw"), alpha))
    if final_ratings is not None or "final_rating" not in dems.columns:
        dems = with_final_ratings(dems, final_ratings)
    dems = flagged(with_lines(dems, score)).cache()  # a row for each district of one cycle
    try:
        counts = dems.agg(F.count("*"), F.count_if(is_close("margin_pct"))).first()
        metrics = [r.asDict() for r in shares_at(dems, grid).orderBy("line", "n").collect()]
        ci, shares = {}, {}
        if counts[0]:
            drawn = simulate.resampled_shares(dems, LINES, headline_n, {name: F.col(flag) for name, flag in HITS.items()}, reps, seed, ["state", "district"])
            found = {(r["line"], r["name"]): r for r in simulate.intervals(drawn, list(HITS)).collect()}  # a row a line and share
            ci = {line: [round(found[line, "close"][x], 4) for x in ("ci_low", "mean", "ci_high")] for line in LINES}
            point = hit_shares(dems, headline_n).first()
            shares = {name: [point[name], round(found["model", name]["ci_low"], 4), round(found["model", name]["ci_high"], 4)] for name in HITS}
        return Run(feature_set, model, combine, universe_name, snapshot, tuple(train_cycles), test_cycle, headline_n, counts[0], counts[1], metrics, ci, shares)
    finally:
        dems.unpersist()


def append_json(row: Run, path: str) -> None:
    with open(path, "a") as f:
        f.write(row.to_json() + "\n")


def report(row: Run) -> str:
    """One run as text."""
    head = f"{row.feature_set} / {row.model} / {row.combine}: train {','.join(map(str, row.train_cycles))}, test {row.test_cycle} at {row.snapshot}; {row.n_close} of {row.n_rows} close"
    body = [f"  N={n:>3} " + "  ".join(f"{m['line']} {m['close_share']:.4f}" for m in row.metrics if m["n"] == n) for n in sorted({m["n"] for m in row.metrics})]
    intervals = [f"  {k}: {v[0]:.4f} to {v[2]:.4f}" for k, v in row.ci.items()]
    return "\n".join([head, *body, *intervals, *(f"  {k} share: {x:.4f} ({lo:.4f} to {hi:.4f})" for k, (x, lo, hi) in row.shares.items())])


def close_share(row: Run, line: str = "model", n: int | None = None) -> float | None:
    """The nested metric of one line at one N (the headline's if not given)."""
    return next((m["close_share"] for m in row.metrics if m["line"] == line and m["n"] == (n or row.headline_n)), None)


def grid_shares(dems: DataFrame, alphas: tuple[float, ...], n: int, fold: str = "fold") -> DataFrame:
    """dems: fold, base, need_raw, margin_pct and the flags. fold, alpha and the share of dollars over the top ``n`` for each of HITS: all folds and alphas in one ranking."""
    values = F.broadcast(dems.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double"))  # a handful
    rows = flagged(dems).crossJoin(values)
    rows = rows.withColumn("impact", nx.need_boost(F.col("base"), F.col("need_raw"), F.col("alpha")))
    parts = allocate_by(rows, [fold, "alpha"], "impact", n, ["state", "district"])
    return parts.groupBy(fold, "alpha").agg(*(F.round(dollar_share("part", F.col(flag)), 4).alias(name) for name, flag in HITS.items()))


def grid_means(shares: DataFrame) -> DataFrame:
    """alpha and the means over the folds that have a share; the deviation is the population's."""
    return shares.groupBy("alpha").agg(F.avg("close").alias("mean_close_race"), F.stddev_pop("close").alias("std_close_race"), F.avg("pivotal").alias("mean_pivotal"), F.avg("under_floor").alias("mean_floor_sat"))


def alpha_grid(matrix: DataFrame, cycles: tuple[int, ...], snapshot: str, alphas: tuple[float, ...] = ALPHAS, headline_n: int = 10, **settings) -> list[dict]:
    """Leave one cycle out: means of the close, pivotal and floor shares for each alpha; folds that cannot be fitted are passed over and counted.

    A fold's models, simulation and floor do not depend on alpha: they are made once a fold, and alpha is a column of what follows.
    """
    if len(set(cycles)) < 2:
        raise ValueError("leaving one cycle out needs two cycles")
    keep = ["state", "district", "margin_pct", "total_trans", "base", "need_raw", "pivotal", "under_floor"]
    folds: list[DataFrame] = []
    for fold in cycles:
        try:
            dems = scored(matrix, tuple(c for c in cycles if c != fold), fold, snapshot, combine="impact", **settings)
        except ValueError:
            continue
        folds.append(saved(dems.select(F.lit(fold).alias("fold"), *keep)))
    found = {}
    if folds:
        found = {r["alpha"]: r.asDict() for r in grid_means(grid_shares(reduce(DataFrame.unionByName, folds), alphas, headline_n)).collect()}
        dropped(*folds)
    none = dict.fromkeys(("mean_close_race", "std_close_race", "mean_pivotal", "mean_floor_sat"))
    return [{"alpha": a, "n_folds": len(folds), "failed": len(cycles) - len(folds)} | none | found.get(a, {}) for a in alphas]


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Cycles or snapshots under each other; a column that one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def best_row(rows: DataFrame, metric: str) -> DataFrame:
    """The row of the greatest metric, of equal ones the smallest alpha; none where no row has one."""
    return rows.dropna(subset=[metric]).orderBy(F.desc(metric), "alpha").limit(1)


def best_alpha(rows: list[dict], metric: str = "mean_close_race") -> float:
    """Greatest metric, of equal ones the smallest alpha; the default where none has one."""
    known = [r for r in rows if r.get(metric) is not None and r[metric] == r[metric]]
    return min(known, key=lambda r: (-r[metric], r["alpha"]))["alpha"] if known else DEFAULT_ALPHA


def n_sensitivity(row: Run) -> list[dict]:
    return [{"n": n} | {m["line"]: m["close_share"] for m in row.metrics if m["n"] == n} for n in sorted({m["n"] for m in row.metrics})]


def ablation(runs: dict[str, Run]) -> list[dict]:
    """label of a choice of training cycles: its run. The headline shares of each."""
    at = lambda r, name: r.shares[name][0] if r.shares else None
    return [{"label": label, "train_cycles": ",".join(map(str, r.train_cycles)), "close_race": close_share(r), "final_ratings": close_share(r, "final_ratings"), "pivotal": at(r, "pivotal"), "under_floor": at(r, "under_floor")} for label, r in runs.items()]


#: Columns of the calibration's tables, so that a table without any value has its types.
ALPHA_GRID = "alpha double, n_folds int, failed int, mean_close_race double, std_close_race double, mean_pivotal double, mean_floor_sat double"
N_SENSITIVITY = "n int, " + ", ".join(f"{line} double" for line in LINES)
ABLATION = "label string, train_cycles string, close_race double, final_ratings double, pivotal double, under_floor double"
SUMMARY = "best_alpha double, alphas array<double>, snapshot string, feature_set string, train_cycles array<int>, test_cycle int"


def calibrate(matrix: DataFrame, train_cycles: tuple[int, ...], test_cycle: int, snapshot: str, without: int | None = None, alphas: tuple[float, ...] = ALPHAS, feature_set: str = "full", headline_n: int = 10, reps: int = 100, grid: tuple[int, ...] = GRID, **settings) -> dict[str, DataFrame]:
    """alpha_grid, n_sensitivity, cycle_ablation and summary, a small table each.

    alpha is the best of the grid over the training cycles; the test cycle is then run with all of them, which gives the table
    by N, and without one (the first if none is named), which gives the ablation with the run before.
    """
    left_out = min(train_cycles) if without is None else without
    kept = tuple(c for c in train_cycles if c != left_out)
    if not kept or len(kept) == len(train_cycles):
        raise ValueError(f"cycle {left_out} cannot be left out of {train_cycles}")
    rows = alpha_grid(matrix, train_cycles, snapshot, alphas, headline_n, feature_set=feature_set, **settings)
    alpha = best_alpha(rows)
    at = {"feature_set": feature_set, "combine": "impact", "alpha": alpha, "headline_n": headline_n, "reps": reps, "grid": grid} | settings
    whole = run(matrix, train_cycles, test_cycle, snapshot, **at)
    runs = {f"with_{left_out}": whole, f"without_{left_out}": run(matrix, kept, test_cycle, snapshot, **at)}
    summary = {"best_alpha": alpha, "alphas": list(alphas), "snapshot": snapshot, "feature_set": feature_set, "train_cycles": list(train_cycles), "test_cycle": test_cycle}
    tables = {"alpha_grid": (rows, ALPHA_GRID), "n_sensitivity": (n_sensitivity(whole), N_SENSITIVITY), "cycle_ablation": (ablation(runs), ABLATION), "summary": ([summary], SUMMARY)}
    return {name: matrix.sparkSession.createDataFrame(values, schema) for name, (values, schema) in tables.items()}


def deciles(df: DataFrame, score: str) -> list[float]:
    """Nine cuts, each raised by 1e-9 where it equals the one before; ValueError without scores."""
    cuts = percentiles(df, score, [i / 10 for i in range(1, 10)]).first()[0]
    if cuts[0] is None:
        raise ValueError("no scores to cut")
    out: list[float] = []
    for c in cuts:
        out.append(c if not out or c > out[-1] else out[-1] + 1e-9)
    return out


def apply_deciles(df: DataFrame, score: str, cuts: list[float], out: str = "impact_decile") -> DataFrame:
    if len(cuts) != 9 or sorted(cuts) != list(cuts):
        raise ValueError("nine ascending cuts are needed")
    return df.withColumn(out, nx.bin_of(F.col(score), F.array(*map(F.lit, cuts))))


APP_COLUMNS = ("snapshot", "state", "district", "candidate_name", "last_name", "party_major", "incumbent", "impact", "impact_decile", "competitiveness", "stakes_normalized", "stakes_raw", "need_raw", "predicted_margin_median", "viable_floor", "total_trans", "opp_raised", "ie_for_total", "ie_against_total", "cook_rating", "cpvi", "margin_pct", "winner")


def bake(matrix: DataFrame, train_cycles: tuple[int, ...], test_cycle: int, snapshots: tuple[str, ...], cuts: list[float] | None = None, feature_set: str = "full", n_iter: int = 10_000, alpha: float = DEFAULT_ALPHA, seed: int = 42, uncontested_d: int = 0) -> DataFrame:
    """The app's table: the test cycle's D candidates at each snapshot, scored and binned."""
    out = None
    for snapshot in snapshots:
        at = matrix.where(F.col("snapshot") == snapshot)
        train, test = at.where(F.col("cycle").isin(*train_cycles)), at.where(F.col("cycle") == test_cycle)
        scored = models.score_quantiles(models.predict_quantiles(test, models.fit_quantiles(train, feature_set), feature_set)).where(F.col("party_major") == "D")
        scored = scored.withColumn("predicted_margin_median", F.get("quantiles", F.lit(nx.LEVELS.index(0.5)))).withColumn("seat", F.concat_ws("-", "state", "district"))
        rows = combine_need(combine_stakes(scored.join(simulate.stakes(scored, n_iter, simulate.sigma_for(snapshot), seed, uncontested_d), "seat")), models.fit_floor(train), alpha)
        rows = apply_deciles(rows, "impact", cuts or deciles(rows, "impact"))
        rows = rows.select(*(c for c in APP_COLUMNS if c in rows.columns))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def splitter(app: DataFrame, snapshot: str, budget: float, n: int, states: tuple[str, ...] = (), decile_range: tuple[int, int] = (1, 10), score: str = "impact") -> DataFrame:
    """The app's answer: rows of the chosen snapshot, states (none: all) and deciles, with their part of the budget."""
    rows = app.where((F.col("snapshot") == snapshot) & F.col("impact_decile").between(*decile_range))
    rows = rows.where(F.col("state").isin(*states)) if states else rows
    return allocate(rows, score, budget, n).orderBy(F.desc(score), "state", "district")


def splitter_shares(allocated: DataFrame) -> DataFrame:
    return allocated.agg(dollar_share("allocation", is_close("margin_pct")).alias("close_share"), dollar_share("allocation", F.coalesce(F.abs("stakes_raw") > simulate.PIVOTAL, F.lit(False))).alias("pivotal_share"), dollar_share("allocation", F.coalesce(F.col("total_trans") < F.col("viable_floor"), F.lit(False))).alias("under_floor_share"))


def residuals(df: DataFrame) -> DataFrame:
    """Median prediction against the margin, by rating: size, mean and sample deviation."""
    r = F.col("margin_pct") - F.col("predicted_margin_median")
    return df.groupBy("cook_rating").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"))


def calibration_bins(df: DataFrame, score: str = "competitiveness", bins: int = 7) -> DataFrame:
    """Right-closed bins of equal width over the scores' range: size, mean score, share of close races."""
    bounds = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))  # one row
    place = F.greatest(F.ceil((F.col(score) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(1))
    return df.crossJoin(F.broadcast(bounds)).withColumn("bin", place).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(is_close("margin_pct").cast("double")).alias("close_rate"))
