"""Quantile regression over partitions: exact minimisers of the pinball loss with absolute weights' penalty, for all levels at once.

A fit never brings its rows together. Every pass is one scan in which each task sums, for all levels, what is needed: loss,
gradient and Gram matrix of a smoothed loss for Newton's steps, or the rows near the present planes. Three stages:

1. Newton on the smoothed loss, the smoothing lowered step by step and each step warm from the one before, until few rows lie
   near enough to a plane for it to matter. With at most ``NEAR`` rows there is nothing to do here.
2. The rows nearest to a plane, at most ``NEAR`` a level, are kept; those above and those below are one row each, their mean
   with their number. This small program is solved exactly by an interior point method.
3. A pass counts the rows that were taken together and now lie on the other side. With none, the small program's optimum is
   that of all rows (its loss is nowhere above theirs, and equal where all keep their side); else 2 and 3 go on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallygrove.session import dropped, saved

#: Rows of a level that are solved for one by one; passes of each stage.
NEAR, NEWTON, ROUNDS = 4000, 60, 30
#: Places of the histogram of distances to a plane.
BINS = 200


def fit_quantile(x: np.ndarray, y: np.ndarray, q: float, alpha: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept of least mean pinball loss plus ``alpha`` times the weights' absolute sum; ``weight``: rows that each row counts for.

    The linear program min c'z, Az + b = y, z >= 0 over z = (w+, w-, u, v) and the free intercept b, solved by Mehrotra's
    predictor-corrector method; AA' is diagonal plus low rank, so a step costs n * p**2.
    """
    n, p = x.shape
    shift, scale = float(np.median(y)), float(max(np.abs(y - np.median(y)).max(), 1e-12))
    y = (y - shift) / scale
    k = 2 * p
    low = np.hstack([x, -x])
    times_of = np.ones(n) if weight is None else weight * (n / weight.sum())
    c = np.concatenate([np.full(k, max(alpha, 1e-9) * n), q * times_of, (1 - q) * times_of])

    def times(z: np.ndarray) -> np.ndarray:
        return low @ z[:k] + z[k : k + n] - z[k + n :]

    def turned(v: np.ndarray) -> np.ndarray:
        return np.concatenate([low.T @ v, v, -v])

    def longest(a: np.ndarray, da: np.ndarray) -> float:
        down = da < 0
        return min(1.0, float((-a[down] / da[down]).min())) if down.any() else 1.0

    z, b, v = np.concatenate([np.ones(k), np.maximum(y, 0) + 1, np.maximum(-y, 0) + 1]), 0.0, np.zeros(n)
    s = c + 0.1
    best = np.inf, z
    for _ in range(100):
        if not np.isfinite(z).all():
            break
        primal, dual, free, gap = y - times(z) - b, c - turned(v) - s, -v.sum(), z @ s / len(z)
        off = max(np.abs(primal).max(), np.abs(dual).max(), abs(free), gap)
        if off < best[0]:
            best = off, z.copy()
        # The systems grow singular near the solution; what is lost there is not won back.
        if off < 1e-9 or best[0] < 1e-5 and off > 10 * best[0]:
            break
        d = z / s
        diagonal = d[k : k + n] + d[k + n :]
        scaled = low / diagonal[:, None]
        inner = np.diag(1 / d[:k]) + low.T @ scaled

        def solve(r: np.ndarray, diagonal=diagonal, scaled=scaled, inner=inner) -> np.ndarray:
            return r / diagonal - scaled @ np.linalg.solve(inner, scaled.T @ r)

        try:
            ones = solve(np.ones(n))
        except np.linalg.LinAlgError:  # singular to the last digit: what is best so far is as near as it gets
            break

        def step(target: np.ndarray, d=d, primal=primal, dual=dual, free=free, ones=ones, solve=solve, s=s) -> tuple:
            r = solve(primal + times(d * dual - target / s))
            db = (r.sum() - free) / ones.sum()
            dv = r - ones * db
            ds = dual - turned(dv)
            return target / s - d * ds, db, dv, ds

        dz, db, dv, ds = step(-z * s)
        mu = ((z + longest(z, dz) * dz) @ (s + longest(s, ds) * ds) / len(z) / gap) ** 3 * gap
        dz, db, dv, ds = step(mu - z * s - dz * ds)
        a, e = 0.99 * longest(z, dz), 0.99 * longest(s, ds)
        z, b, v, s = z + a * dz, b + a * db, v + e * dv, s + e * ds
    w = best[1][:p] - best[1][p:k]
    w[np.abs(w) < 1e-6] = 0
    r = y - x @ w
    order = np.argsort(r)
    b = float(r[order[np.argmax(np.cumsum(times_of[order]) >= q * n * (1 - 1e-12))]])

    # The penalty as rows of their own, whose residuals are the weights.
    rows = np.vstack([np.hstack([x, np.ones((n, 1))]), np.eye(p, p + 1)])
    up, down = np.concatenate([q * times_of, np.full(p, alpha * n)]), np.concatenate([(1 - q) * times_of, np.full(p, alpha * n)])
    exact = _vertex(rows, np.concatenate([y, np.zeros(p)]), up, down, np.append(w, b))
    return exact[:p] * scale, float(exact[p]) * scale + shift


def _vertex(a: np.ndarray, y: np.ndarray, up: np.ndarray, down: np.ndarray, start: np.ndarray, pivots: int = 500) -> np.ndarray:
    """The optimum near ``start`` of the sum of up * r and -down * r over residuals r = y - a z above and below 0.

    It is a vertex, at which as many independent rows as there are columns have residuals of 0. From the rows nearest to the
    start, a row whose multiplier is out of its bounds is left along the edge that keeps the others, as far as the loss falls.
    """

    def loss(z: np.ndarray) -> float:
        r = y - a @ z
        return float(np.maximum(up * r, -down * r).sum())

    base = _independent(a, np.argsort(np.abs(y - a @ start), kind="stable"))
    if len(base) < a.shape[1]:
        return start
    best, z = (loss(start), start), start
    for _ in range(pivots):
        z = np.linalg.solve(a[base], y[base])
        r = y - a @ z
        r[base] = 0
        if (now := loss(z)) <= best[0]:
            best = now, z
        u = -np.linalg.solve(a[base].T, np.where(r > 0, up, np.where(r < 0, -down, 0)) @ a)
        over = np.maximum(u - up[base], -down[base] - u)
        out = int(np.argmax(over))
        if over[out] <= 1e-9 * max(1.0, float(up.max())):
            return z
        step = np.linalg.solve(a[base], np.eye(len(base))[out] * (-1.0 if u[out] > up[base[out]] else 1.0))
        moved = a @ step
        moved[base] = 0
        at = np.divide(r, moved, out=np.full(len(y), np.inf), where=np.abs(moved) > 1e-12)
        ahead = np.flatnonzero((at > 0) & np.isfinite(at))
        ahead = ahead[np.argsort(at[ahead])]
        turned = np.cumsum(np.abs(moved[ahead]) * (up + down)[ahead]) >= over[out]
        if not turned.any():
            break
        base[out] = int(ahead[np.argmax(turned)])
    return best[1]


def _independent(rows: np.ndarray, order: np.ndarray) -> list[int]:
    """The first rows in ``order`` that are linearly independent, as many as there are columns where there are."""
    out: list[int] = []
    base = np.zeros((0, rows.shape[1]))
    for i in order:
        left = rows[i] - base.T @ (base @ rows[i])
        size = np.linalg.norm(left)
        if size > 1e-7 * max(np.linalg.norm(rows[i]), 1e-300):
            base = np.vstack([base, left / size])
            out.append(int(i))
            if len(out) == rows.shape[1]:
                break
    return out


def pinball(x: np.ndarray, y: np.ndarray, q: float, alpha: float, w: np.ndarray, b: float) -> float:
    r = y - x @ w - b
    return float(np.maximum(q * r, (q - 1) * r).mean() + alpha * np.abs(w).sum())


@dataclass(frozen=True)
class Scaled:
    """Mean and deviation of features; a deviation of 0 counts 1."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale


def _arrays(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, values and how many rows are equal."""
    x, y, n = batch.columns
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, p), y.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False).astype(float)


def _sums(rows: DataFrame, p: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of an array that ``of`` gives for some of them: one array a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = of(*_arrays(batch, p))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    got = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    return np.array([r["x"] for r in got.orderBy("at").collect()])


def _moments(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.concatenate([[weight.sum()], weight @ x, [weight @ y]])


def _residuals(x: np.ndarray, y: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Rows by levels; planes: levels by weights and intercept."""
    return y[:, None] - x @ planes[:, :-1].T - planes[:, -1]


def _newton(rows: DataFrame, scaled: Scaled, n: int, p: int, levels: np.ndarray, alpha: float, spread: float, start: np.ndarray) -> np.ndarray:
    """Planes of nearly least loss: one pass gives all levels' loss, gradient and Gram matrix at a trial point."""
    planes, k = start.copy(), p + 1

    def passed(planes: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
            x = scaled(x)
            r, one = _residuals(x, y, planes), np.hstack([x, np.ones((len(x), 1))])
            z = np.clip(r / width, -500, 500)
            share = 1 / (1 + np.exp(z))
            loss = levels * r + width * np.where(z > 0, np.log1p(np.exp(-np.abs(z))), np.log1p(np.exp(-np.abs(z))) - z)
            grams = [(one * (weight * share[:, j] * (1 - share[:, j]) / width)[:, None]).T @ one for j in range(len(levels))]
            return np.concatenate([weight @ loss, (-((levels - share) * weight[:, None]).T @ one).ravel(), np.ravel(grams), (np.abs(r) <= 4 * width).sum(0)])

        total, m = _sums(rows, p, of) / n, len(levels)
        w = planes[:, :-1]
        size = np.sqrt(w * w + width * width)
        gradient, gram = total[m : m + m * k].reshape(m, k), total[m + m * k : m + m * k + m * k * k].reshape(m, k, k)
        gradient[:, :-1] += alpha * w / size
        gram[:, np.arange(p), np.arange(p)] += alpha * width * width / size**3
        return total[:m] + alpha * size.sum(1), gradient, gram, total[-m:] * n

    width, damp = spread / 2, np.full(len(levels), 1e-6)
    loss, gradient, gram, near = passed(planes, width)
    for _ in range(NEWTON):
        moved = np.array([np.linalg.solve(h + d * (np.trace(h) / k + 1e-9) * np.eye(k), g) for h, g, d in zip(gram, gradient, damp, strict=True)])
        done = (np.abs(gradient) < min(1e-3, NEAR / (8 * n))).all(1)
        if done.all():
            if (near <= NEAR / 2).all() or width < 1e-7 * spread:
                break
            width /= 3
            loss, gradient, gram, near = passed(planes, width)
            continue
        trial = np.where(done[:, None], planes, planes - moved)
        got = passed(trial, width)
        better = (got[0] <= loss) | done
        planes = np.where(better[:, None], trial, planes)
        loss, near = np.where(better, got[0], loss), np.where(better, got[3], near)
        gradient, gram = np.where(better[:, None], got[1], gradient), np.where(better[:, None, None], got[2], gram)
        damp = np.where(better, np.maximum(damp / 8, 1e-9), damp * 30)
    return planes


def _reach(rows: DataFrame, scaled: Scaled, p: int, planes: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each level a distance within which ``NEAR`` different rows lie at most."""
    grid = np.concatenate([[0.0], np.geomspace(1e-9, 1, BINS - 1)])

    def of(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        off = np.abs(_residuals(scaled(x), y, planes)) / most
        return np.concatenate([np.bincount(np.searchsorted(grid, off[:, j]), minlength=BINS + 1) for j in range(len(planes))]).astype(float)

    counts = np.cumsum(_sums(rows, p, of).reshape(len(planes), BINS + 1), 1)
    last = np.array([np.searchsorted(c, NEAR, side="right") - 1 for c in counts])
    return np.where(last >= BINS - 1, np.inf, grid[np.clip(last, 0, BINS - 1)] * most)


def _near(rows: DataFrame, scaled: Scaled, p: int, planes: np.ndarray, reach: np.ndarray) -> list[list]:
    """For each level the rows within reach of its plane and how many are equal: ``NEAR`` different ones at most, besides those that lie on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y, weight = _arrays(batch, p)
                row, level = np.nonzero(np.abs(_residuals(scaled(x), y, planes)) <= reach)
                yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), batch.column(0).take(pa.array(row)), pa.array(y[row]), pa.array(weight[row])], ["level", "x", "y", "n"])

    out: list[list] = [[] for _ in planes]
    for r in rows.mapInArrow(run, "level int, x array<double>, y double, n double").collect():
        out[r["level"]].append((r["x"], r["y"], r["n"]))
    return out


def fit(rows: DataFrame, p: int, levels: tuple[float, ...], alpha: float, least: int) -> list[Row]:
    """rows: features (``p`` numbers), y. level, weights and intercept of each level; ValueError under ``least`` rows."""
    rows = saved(rows.groupBy("features", "y").count())  # equal rows count as one, so a plane through most rows is one through few
    try:
        sums = _sums(rows, p, _moments)
        n = round(sums[0]) if len(sums) else 0
        if n < least:
            raise ValueError(f"{n} rows are too few")
        mean, centre = sums[1:-1] / n, sums[-1] / n
        squares = _sums(rows, p, lambda x, y, weight: np.concatenate([weight @ (x - mean) ** 2, [weight @ (y - centre) ** 2]])) / n
        deviation = np.sqrt(squares)
        scaled, spread = Scaled(mean, np.where(deviation[:-1] <= 1e-12 * np.maximum(np.abs(mean), 1), 1.0, deviation[:-1])), max(deviation[-1], 1e-12)
        q = np.array(levels)
        planes = np.hstack([np.zeros((len(q), p)), centre + spread * (2 * q[:, None] - 1)])
        if n > NEAR:
            planes = _newton(rows, scaled, n, p, q, alpha, spread, planes)
        planes = _exact(rows, scaled, n, p, q, alpha, planes, 1e-9 * spread)
        return [Row(level=float(a), weights=(w[:-1] / scaled.scale).tolist(), intercept=float(w[-1] - (w[:-1] * mean / scaled.scale).sum())) for a, w in zip(q, planes, strict=True)]
    finally:
        dropped(rows)


def _exact(rows: DataFrame, scaled: Scaled, n: int, p: int, levels: np.ndarray, alpha: float, planes: np.ndarray, slack: float) -> np.ndarray:
    for _ in range(ROUNDS):
        most = np.array([_greatest(rows, scaled, p, planes)]) if n > NEAR else np.array([1.0])
        reach = _reach(rows, scaled, p, planes, most) if n > NEAR else np.full(len(planes), np.inf)

        def sides(x: np.ndarray, y: np.ndarray, weight: np.ndarray, planes=planes, reach=reach) -> np.ndarray:
            """Number, sums of x and y of the rows beyond reach, above and below, for each level."""
            x = scaled(x)
            r, cells = _residuals(x, y, planes), np.hstack([np.ones((len(x), 1)), x, y[:, None]])
            return np.concatenate([(hit * weight[:, None]).T @ cells for hit in (r > reach, r < -reach)]).ravel()

        together = _sums(rows, p, sides).reshape(2, len(levels), p + 2)
        near = _near(rows, scaled, p, planes, reach)
        solved = []
        for j, a in enumerate(levels):
            x = scaled(np.array([r[0] for r in near[j]], float).reshape(-1, p))
            extra = [t[j] for t in together if t[j][0] > 0]
            xs = np.vstack([x, *(e[1:-1] / e[0] for e in extra)])
            ys = np.array([*(r[1] for r in near[j]), *(e[-1] / e[0] for e in extra)])
            w, b = fit_quantile(xs, ys, float(a), alpha, np.array([*(float(r[2]) for r in near[j]), *(e[0] for e in extra)]))
            solved.append([*w, b])
        new = np.array(solved)

        def crossed(x: np.ndarray, y: np.ndarray, weight: np.ndarray, planes=planes, reach=reach, new=new) -> np.ndarray:
            x = scaled(x)
            r, now = _residuals(x, y, planes), _residuals(x, y, new)
            return (((r > reach) & (now < -slack)) | ((r < -reach) & (now > slack))).sum(0).astype(float)

        planes = new
        if not n > NEAR or not _sums(rows, p, crossed).any():
            break
    return planes


def _greatest(rows: DataFrame, scaled: Scaled, p: int, planes: np.ndarray) -> float:
    """The greatest distance of any row to any plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y, _ = _arrays(batch, p)
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(_residuals(scaled(x), y, planes)).max())])], ["far"])

    return max(rows.mapInArrow(run, "far double").agg(F.max("far")).first()[0], 1e-12)
