"""Linear fits of all folds, scalers and parameters from one pass over the data.

The pass gives, per block of rows, the sums of products of features, target and the constant. They
are packed per Arrow batch, so a task sends one small matrix per block and batch group, and the
cluster adds them up. What reaches the driver is ``blocks * (d + 2)**2`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.layout import complete_rows


@dataclass(frozen=True)
class Gram:
    """Sums over one set of rows of ``v = (1, x - origin, y - origin)``, where an unknown ``x`` counts 0.

    ``m`` are the products ``v v'``, ``a`` those of ``v`` with the marks of known features, ``r`` those of
    the marks. With them the sums can be had for unknown values replaced by any means, so every fold
    fills gaps with the means of its own train part.
    """

    m: np.ndarray
    a: np.ndarray
    r: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    origin: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.m + other.m, self.a + other.a, self.r + other.r, np.minimum(self.lo, other.lo), np.maximum(self.hi, other.hi), self.origin)

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    @property
    def _shift(self) -> np.ndarray:
        """Means of the known values, from the origin; 0 where none is known."""
        return np.divide(self.m[0, 1:-1], self.a[0], out=np.zeros(len(self.a[0])), where=self.a[0] > 0)

    @property
    def mean(self) -> np.ndarray:
        return self._shift + self.origin[:-1]

    @property
    def y_mean(self) -> float:
        return float(self.m[0, -1] / self.n + self.origin[-1])

    def low(self) -> np.ndarray:
        return np.where(self.a[0] > 0, self.lo[:-1] + self.origin[:-1], self.mean)

    def high(self) -> np.ndarray:
        return np.where(self.a[0] > 0, self.hi[:-1] + self.origin[:-1], self.mean)

    def around(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``Z'Z``, ``Z'(y - its mean)`` and ``Z'1`` for ``Z = x - mean``, 0 where x is unknown."""
        t = mean - self.origin[:-1]
        a = self.a[1:-1]
        zz = self.m[1:-1, 1:-1] - a * t[None, :] - a.T * t[:, None] + np.outer(t, t) * self.r
        z1 = self.m[0, 1:-1] - t * self.a[0]
        zy = self.m[-1, 1:-1] - t * self.a[-1] - z1 * self.m[0, -1] / self.n
        return zz, zy, z1

    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """``Xc'Xc``, ``Xc'yc``, ``yc'yc`` with gaps filled by the means."""
        zz, zy, _ = self.around(self.mean)
        return zz, zy, float(self.m[-1, -1] - self.m[0, -1] ** 2 / self.n)

    def take(self, places: Sequence[int]) -> Gram:
        """The same sums for some of the columns; the last one taken is the target, which must be known in every row."""
        cols = np.asarray(places, dtype=int)
        full = np.concatenate([[0], cols + 1])
        return Gram(self.m[np.ix_(full, full)], self.a[np.ix_(full, cols[:-1])], self.r[np.ix_(cols[:-1], cols[:-1])],
                    self.lo[cols], self.hi[cols], self.origin[cols])


ORIGIN_ROWS = 1_000


# For block numbers and values (features, then target) of some rows: any number of pairs of (keys, values).
Versions = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def gram_blocks(df: DataFrame, features: Sequence[str], y: str, block_col: str = "block", required: Sequence[str] = (),
                versions: Versions | None = None) -> dict[int, Gram]:
    """Gram sums per block, of the rows with a target (and the ``required`` columns); features may be null or NaN.

    Values are shifted by the means of a few rows first: any origin near the data keeps the accuracy, and
    the frame itself is read once. ``versions`` gives the rows anew, under keys of their own, any number of times:
    so rows scaled for every fold are summed in the same pass.
    """
    cols = [*features, y]
    d = len(features)
    cast = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)]
    must = [f"x{i}" for i, c in enumerate(cols) if i == d or c in required]
    rows = complete_rows(df.select(F.col(block_col).cast("int").alias("block"), *cast), must)
    origin_row = rows.limit(ORIGIN_ROWS).agg(*[F.avg(f"x{i}") for i in range(d + 1)]).first()
    origin = np.array([v or 0.0 for v in origin_row], dtype=float)
    if versions is not None:
        origin[:-1] = 0.0
    shapes = ((d + 2, d + 2), (d + 2, d), (d, d))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[np.ndarray]] = {}

        def add(keys: np.ndarray, values: np.ndarray) -> None:
            for b in np.unique(keys):
                part = values[keys == b] - origin
                known = ~np.isnan(part)
                v = np.hstack([np.ones((len(part), 1)), np.where(known, part, 0.0)])
                marks = known[:, :d].astype(float)
                new = [v.T @ v, v.T @ marks, marks.T @ marks, np.where(known, part, np.inf).min(axis=0), np.where(known, part, -np.inf).max(axis=0)]
                old = sums.get(b)
                sums[b] = new if old is None else [*(p + q for p, q in zip(old[:3], new[:3])), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]

        for pdf in batches:
            blocks, values = pdf["block"].to_numpy(), pdf.iloc[:, 1:].to_numpy(dtype=float)
            for keys, some in [(blocks, values)] if versions is None else versions(blocks, values):
                add(keys, some)
        for b, (m, a, r, lo, hi) in sums.items():
            yield pd.DataFrame({"block": [int(b)], "g": [np.concatenate([x.ravel() for x in (m, a, r)]).tolist()], "lo": [lo.tolist()], "hi": [hi.tolist()]})

    parts = rows.mapInPandas(partial, "block int, g array<double>, lo array<double>, hi array<double>")
    # One pass: the numbers of a block in a row, the first of them sums, then smallest and largest values.
    cells = parts.select("block", F.posexplode(F.concat("g", "lo", "hi")).alias("i", "v")) \
        .groupBy("block", "i").agg(F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Bounded: a few (d + 2)**2 rows a block, whatever the size of the data.
    got = cells.toPandas()
    ends = np.cumsum([0, *(p * q for p, q in shapes), d + 1, d + 1])
    out = {}
    for b, mine in got.groupby("block"):
        mine = mine.sort_values("i")
        pick = [mine[k].to_numpy()[lo:hi] for k, lo, hi in zip(("total", "total", "total", "lo", "hi"), ends[:-1], ends[1:])]
        out[int(b)] = Gram(*(x.reshape(shape) for x, shape in zip(pick[:3], shapes)), pick[3], pick[4], origin)
    return out


def scaler_vectors(g: Gram, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Shift and scale per feature for the affine scalers that sums alone determine."""
    if kind == "none":
        return np.zeros(len(g.mean)), np.ones(len(g.mean))
    if kind == "minmax":
        shift, scale = g.low(), g.high() - g.low()
    elif kind == "standard":
        xx, _, _ = g.centred()
        shift, scale = g.mean, np.sqrt(np.maximum(np.diag(xx) / g.n, 0.0))
    else:
        raise KeyError(kind)
    return shift, np.where(scale == 0, 1.0, scale)


def correlations(g: Gram) -> np.ndarray:
    """Of every feature, gaps taken for its mean, with the target."""
    xx, xy, yy = g.centred()
    den = np.sqrt(np.maximum(np.diag(xx), 0.0) * yy)
    return np.divide(xy, den, out=np.zeros_like(xy), where=den > 0)


@dataclass(frozen=True)
class Problem:
    """Centred, scaled sums of one set of rows: what a linear fit needs."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: float


def solve(kind: str, xx: np.ndarray, xy: np.ndarray, yy: float, n: float, params: dict) -> np.ndarray:
    """Coefficients on centred, scaled features. All solvers are d x d."""
    return solve_many(kind, [Problem(xx, xy, yy, n)], [params])[0, 0]


def solve_many(kind: str, problems: Sequence[Problem], draws: Sequence[dict]) -> np.ndarray:
    """Coefficients (problem, draw, feature) of problems with the same number of features."""
    k = len(problems[0].xy)
    out = np.zeros((len(problems), len(draws), k))
    if not k:
        return out
    if kind in ("lasso", "elasticnet"):
        grid = [(p, d) for p in problems for d in draws]
        n = np.array([p.n for p, _ in grid])
        alpha = np.array([float(d.get("alpha", 1.0)) for _, d in grid])
        share = np.array([1.0 if kind == "lasso" else float(d.get("l1_ratio", 0.5)) for _, d in grid])
        tol = np.array([float(d.get("tol", 1e-4)) for _, d in grid])
        most = max(int(d.get("max_iter", 1000)) for d in draws)
        start = None
        if kind == "lasso":
            start = np.concatenate([lasso_path(p.xx, p.xy, p.n * np.array([float(d.get("alpha", 1.0)) for d in draws])) for p in problems])
        b = descend_many(np.array([p.xx for p, _ in grid]), np.array([p.xy for p, _ in grid]), alpha * share * n, alpha * (1 - share) * n, tol, most, start)
        return b.reshape(out.shape)
    for i, p in enumerate(problems):
        if kind == "linear":
            out[i] = np.linalg.lstsq(p.xx, p.xy, rcond=None)[0]
        elif kind == "ridge":
            alphas = np.array([float(d.get("alpha", 1.0)) for d in draws])
            out[i] = np.linalg.solve(p.xx + alphas[:, None, None] * np.eye(k), np.broadcast_to(p.xy[:, None], (len(draws), k, 1)))[:, :, 0]
        elif kind == "bayesridge":
            out[i] = _evidence(p, draws)
        else:
            raise KeyError(kind)
    return out


POLISH = 8


def lasso_path(xx: np.ndarray, xy: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Minima of ``1/2 b'XX b - b'xy + l |b|_1`` for several ``l``, by following them as ``l`` falls.

    Between two values of ``l`` at which a feature joins or leaves, the coefficients move on a straight line. A feature
    that the others determine is left out; the caller's descent goes on from there.
    """
    out = np.zeros((len(penalties), len(xy)))
    order = np.argsort(-penalties, kind="stable")
    if not len(xy) or not np.abs(xy).max() > 0:
        return out
    scale = np.sqrt(np.maximum(np.diagonal(xx), 0.0))
    b, c, now = np.zeros(len(xy)), xy.copy(), float(np.abs(xy).max())
    out_of_it = scale <= 0
    active: list[int] = [int(np.argmax(np.where(out_of_it, -1.0, np.abs(xy))))]
    signs = {active[0]: np.sign(xy[active[0]])}
    left, done = -1, 0
    for _ in range(20 * len(xy)):
        while done < len(order) and penalties[order[done]] >= now:
            out[order[done]] = b
            done += 1
        if done == len(order) or not active:
            break
        s = np.array([signs[j] for j in active])
        part = xx[np.ix_(active, active)]
        norm = scale[active]
        try:
            lower = np.linalg.cholesky(part / np.outer(norm, norm))
        except np.linalg.LinAlgError:
            lower = np.zeros((1, 1))
        if lower[-1, -1] < 1e-6:  # the newest feature follows from the others
            j = active.pop()
            out_of_it[j] = True
            b[j] = 0.0
            continue
        d = np.linalg.solve(part, s)
        a = xx[:, active] @ d
        with np.errstate(divide="ignore", invalid="ignore"):
            up, down = (now - c) / (1 - a), (now + c) / (1 + a)
        idle = ~out_of_it
        idle[active] = False
        joins = np.full(len(xy), np.inf)
        for v in (up, down):
            joins = np.where(idle & (v > 1e-12 * now) & (v < joins), v, joins)
        if left >= 0 and joins[left] < 1e-9 * now:
            joins[left] = np.inf
        with np.errstate(divide="ignore", invalid="ignore"):
            leaves = np.where((-b[active] / d) > 1e-12 * now, -b[active] / d, np.inf)
        step = min(float(joins.min(initial=np.inf)), float(leaves.min(initial=np.inf)), now)
        while done < len(order) and penalties[order[done]] >= now - step:
            out[order[done], active] = b[active] + (now - penalties[order[done]]) * d
            done += 1
        if done == len(order):
            break
        b[active] += step * d
        c -= step * a
        now -= step
        left = -1
        if leaves.min(initial=np.inf) <= step:
            left = active[int(leaves.argmin())]
            active.remove(left)
            b[left] = 0.0
        else:
            j = int(joins.argmin())
            active.append(j)
            signs[j] = np.sign(c[j])
    for k in order[done:]:
        out[k] = b
    return out


def descend_many(xx: np.ndarray, xy: np.ndarray, l1: np.ndarray, l2: np.ndarray, tol: np.ndarray, max_iter: int,
                 start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on ``1/2 b'XX b - b'xy + l1 |b|_1 + l2/2 |b|_2^2`` for a stack of problems at once.

    A problem is done when no coefficient moved by more than ``tol`` of the largest. Every few sweeps those left
    are solved directly for the signs they have; where that keeps all signs and no coefficient at zero wants to
    leave it, it is the minimum, which sweeps alone approach slowly where columns go together.
    """
    out = np.zeros_like(xy)
    live = np.arange(len(xy))
    diag = np.diagonal(xx, axis1=1, axis2=2).copy()
    b = np.zeros_like(xy) if start is None else start.copy()
    grad = xy - np.einsum("pij,pj->pi", xx, b)
    columns = [j for j in range(xy.shape[1]) if (diag[:, j] > 0).any()]
    for sweep in range(1, max_iter + 1):
        moved = np.zeros(len(live))
        for j in columns:
            old, d = b[:, j].copy(), diag[:, j]
            rho = grad[:, j] + d * old
            new = np.where(d > 0, np.sign(rho) * np.maximum(np.abs(rho) - l1, 0.0) / np.where(d > 0, d + l2, 1.0), 0.0)
            step = new - old
            if step.any():
                b[:, j] = new
                grad -= xx[:, :, j] * step[:, None]
                moved = np.maximum(moved, np.abs(step))
        done = moved <= tol * np.maximum(np.abs(b).max(axis=1), 1e-300)
        if (sweep == 1 or sweep % POLISH == 0) and not done.all():
            exact, right = _by_signs(xx, xy, l1, l2, b, diag)
            right &= ~done
            b[right] = exact[right]
            done |= right
        if done.any() or sweep == max_iter:
            out[live] = b
            left = ~done
            if not left.any():
                break
            live, xx, xy, l1, l2, tol, diag, b, grad = (v[left] for v in (live, xx, xy, l1, l2, tol, diag, b, grad))
    return out


def _by_signs(xx, xy, l1, l2, b, diag) -> tuple[np.ndarray, np.ndarray]:
    """The stationary point for the signs of ``b``, and whether it is the minimum."""
    signs = np.sign(b)
    on = signs != 0
    eye = np.eye(b.shape[1])
    both = on[:, :, None] & on[:, None, :]
    system = np.where(both, xx, 0.0) + eye * np.where(on, l2[:, None], 1.0)[:, :, None]
    try:
        exact = np.linalg.solve(system, np.where(on, xy - l1[:, None] * signs, 0.0)[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return b, np.zeros(len(b), dtype=bool)
    exact = np.where(on, exact, 0.0)
    rest = xy - np.einsum("pij,pj->pi", xx, exact) - l2[:, None] * exact
    slack = 1e-9 * np.maximum(np.abs(xy).max(axis=1), l1)[:, None]
    held = np.where(on, (np.sign(exact) == signs) & (np.abs(rest - l1[:, None] * signs) <= slack), (np.abs(rest) <= l1[:, None] + slack) | (diag <= 0))
    return exact, held.all(axis=1) & np.isfinite(exact).all(axis=1)


def _evidence(p: Problem, draws: Sequence[dict]) -> np.ndarray:
    """Ridge whose two precisions are set by maximising the evidence (fixed point), for all draws side by side."""
    a1, a2, l1, l2, tol = (np.array([float(d.get(name, default)) for d in draws])
                           for name, default in (("alpha_1", 1e-6), ("alpha_2", 1e-6), ("lambda_1", 1e-6), ("lambda_2", 1e-6), ("tol", 1e-3)))
    values, vectors = np.linalg.eigh(p.xx)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ p.xy
    alpha, lam = np.full(len(draws), 1.0 / (p.yy / p.n + np.finfo(float).eps)), np.ones(len(draws))
    b = np.zeros((len(draws), len(values)))
    live = np.arange(len(draws))
    for _ in range(max(int(d.get("max_iter", 300)) for d in draws)):
        a, m = alpha[live, None], lam[live, None]
        c = rotated / (values + m / a)
        rss = np.maximum(p.yy - 2 * c @ rotated + (c * c) @ values, 0.0)
        gamma = (a * values / (m + a * values)).sum(axis=1)
        lam[live] = (gamma + 2 * l1[live]) / ((c * c).sum(axis=1) + 2 * l2[live])
        alpha[live] = (p.n - gamma + 2 * a1[live]) / (rss + 2 * a2[live])
        new = c @ vectors.T
        done = np.abs(new - b[live]).sum(axis=1) < tol[live]
        b[live] = new
        live = live[~done]
        if not len(live):
            break
    return (rotated / (values + (lam / alpha)[:, None])) @ vectors.T


@dataclass(frozen=True)
class LinearFit:
    """``intercept + coef . x`` on raw features, as a column expression; ``fill`` stands for unknown values."""

    features: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float
    fill: tuple[float, ...] = ()

    def inputs(self) -> list:
        xs = [F.col(f"`{f}`") for f in self.features]
        return [F.coalesce(F.nanvl(x.cast("double"), F.lit(v)), F.lit(v)) for x, v in zip(xs, self.fill)] if self.fill else xs

    def column(self):
        out = F.lit(self.intercept)
        for x, c in zip(self.inputs(), self.coef):
            if c != 0.0:
                out = out + F.lit(c) * x
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.column())


def fit_from_gram(g: Gram, features: Sequence[str], kind: str, params: dict, scaler: str = "none",
                  chosen: Sequence[int] | None = None, scale: np.ndarray | None = None) -> LinearFit:
    """Fit on scaled features, folded back to raw ones. ``scale`` overrides the scaler's factors."""
    idx = np.arange(len(features)) if chosen is None else np.asarray(chosen, dtype=int)
    xx, xy, yy = g.centred()
    if scale is None:
        _, scale = scaler_vectors(g, scaler)
    sc = scale[idx]
    beta = solve(kind, xx[np.ix_(idx, idx)] / np.outer(sc, sc), xy[idx] / sc, yy, g.n, params) / sc
    return LinearFit(tuple(features[i] for i in idx), tuple(float(v) for v in beta),
                     float(g.y_mean - beta @ g.mean[idx]), tuple(float(v) for v in g.mean[idx]))


def errors(g: Gram, fit: LinearFit, features: Sequence[str]) -> tuple[float, float]:
    """Mean squared error and R2 of a fit on the rows behind ``g``, from sums alone."""
    places = {f: i for i, f in enumerate(features)}
    idx = [places[f] for f in fit.features]
    coef, mean = np.zeros((1, len(features))), g.mean
    coef[0, idx] = fit.coef
    mean[idx] = fit.fill
    mse, r2 = errors_many(g, mean, coef, np.array([fit.intercept]))
    return float(mse[0]), float(r2[0])


def errors_many(g: Gram, mean: np.ndarray, coef: np.ndarray, intercept: np.ndarray, around: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Errors of fits (one a row of ``coef``) that take ``mean`` for unknown features; ``around`` is ``g.around(mean)`` if known."""
    zz, zy, z1 = g.around(mean) if around is None else around
    yy = float(g.m[-1, -1] - g.m[0, -1] ** 2 / g.n)
    bias = g.y_mean - intercept - coef @ mean
    sse = np.maximum(yy - 2 * coef @ zy + np.einsum("pi,ij,pj->p", coef, zz, coef, optimize=True) + g.n * bias ** 2 - 2 * bias * (coef @ z1), 0.0)
    return sse / g.n, (1 - sse / yy if yy > 0 else np.full(len(sse), np.nan))
