"""Fits on MLlib. Every ``fit_*`` takes a frame, feature names and target, and gives a `Fitted`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.ml.gram import LinearFit, fit_from_gram, gram_blocks
from tidemill.operators.layout import LEN, POS, names, number_rows
from tidemill.session import settle

# The library's limit, and the depth that stands for "no limit" (None).
MAX_TREE_DEPTH = 30


def tree_depth(depth: int | None) -> int:
    if depth is not None and not 0 <= depth <= MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {depth}: trees here are at most {MAX_TREE_DEPTH} deep")
    return MAX_TREE_DEPTH if depth is None else depth


@dataclass
class Fitted:
    """A fitted pipeline with the plain names of its inputs and what stands for their gaps: the means of the train rows."""

    pipeline: PipelineModel
    features: tuple[str, ...]
    fill: tuple[float, ...] = ()

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        got = self.pipeline.transform(_inputs(df, self.features, self.fill)).drop("_x", *_safe(self.features))
        return got if out == "prediction" else got.withColumnRenamed("prediction", out)

    @property
    def model(self):
        return self.pipeline.stages[-1]


def _safe(features: Sequence[str]) -> list[str]:
    return [f"_in{i}" for i in range(len(features))]


def _inputs(df: DataFrame, features: Sequence[str], fill: Sequence[float] = ()) -> DataFrame:
    """Feature names may hold dots and dashes, which MLlib does not take; a null or NaN takes the value in ``fill``."""
    xs = [F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")) for f in features]
    if fill:
        xs = [F.coalesce(x, F.lit(float(v))) for x, v in zip(xs, fill)]
    return df.withColumns(dict(zip(_safe(features), xs)))


def _fit(train: DataFrame, features: Sequence[str], y: str, estimator) -> Fitted:
    """Every row with a target counts; gaps in features take the feature's mean over those rows."""
    target = F.nanvl(F.col(f"`{y}`").cast("double"), F.lit(None).cast("double"))
    known = train.withColumn("_y", target).filter("_y IS NOT NULL")
    means = _inputs(known, features).agg(*[F.avg(c) for c in _safe(features)]).first()
    fill = tuple(float(m or 0.0) for m in means)
    rows = _inputs(known, features, fill).select(*_safe(features), "_y")
    assembler = VectorAssembler(inputCols=_safe(features), outputCol="_x", handleInvalid="keep")
    model = estimator.setFeaturesCol("_x").setLabelCol("_y").setPredictionCol("prediction").fit(assembler.transform(rows))
    return Fitted(PipelineModel(stages=[assembler, model]), tuple(features), fill)


def fit_linear(train: DataFrame, features: Sequence[str], y: str) -> Fitted:
    return _fit(train, features, y, LinearRegression(regParam=0.0, solver="normal"))


def _target_spread(train: DataFrame, y: str) -> tuple[int, float]:
    """Rows with a target and its spread; MLlib's L2 penalty is relative to that spread."""
    target = F.nanvl(F.col(f"`{y}`").cast("double"), F.lit(None).cast("double"))
    n, sd = train.agg(F.count(target), F.stddev_pop(target)).first()
    return max(n, 1), float(sd or 0.0)


def fit_ridge(train: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> Fitted:
    """L2 penalty ``alpha * |b|^2`` against the sum of squares; MLlib penalises the mean."""
    n, sd = _target_spread(train, y)
    return _fit(train, features, y, LinearRegression(
        regParam=float(alpha) * sd / n, elasticNetParam=0.0, standardization=False, solver="normal"))


def fit_lasso(train: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, tol: float = 1e-10,
              max_iter: int = 1000) -> Fitted:
    return _fit(train, features, y, LinearRegression(
        regParam=float(alpha), elasticNetParam=1.0, standardization=False, tol=tol, maxIter=max_iter))


def fit_elasticnet(train: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, l1_ratio: float = 0.5,
                   tol: float = 1e-10, max_iter: int = 1000) -> Fitted:
    """``alpha * (l1_ratio * |b| + (1 - l1_ratio) / 2 * b^2)`` against half the mean square."""
    _, sd = _target_spread(train, y)
    l1, l2 = float(alpha) * l1_ratio, float(alpha) * (1 - l1_ratio) * sd
    total = l1 + l2
    return _fit(train, features, y, LinearRegression(
        regParam=total, elasticNetParam=l1 / total if total else 0.0, standardization=False, tol=tol, maxIter=max_iter))


def fit_bayesridge(train: DataFrame, features: Sequence[str], y: str, **params) -> LinearFit:
    """Distributed sums, then a d x d fixed point for the two precisions."""
    blocks = gram_blocks(train.withColumn("_one", F.lit(0)), features, y, "_one")
    return fit_from_gram(blocks[0], features, "bayesridge", params)


def fit_tree(train: DataFrame, features: Sequence[str], y: str, max_depth: int | None = 10,
             min_instances: int = 1, seed: int = 42) -> Fitted:
    return _fit(train, features, y, DecisionTreeRegressor(
        maxDepth=tree_depth(max_depth), minInstancesPerNode=min_instances, seed=seed))


def fit_extratree(train: DataFrame, features: Sequence[str], y: str, max_depth: int | None = 10,
                  subset: str = "onethird", seed: int = 42) -> Fitted:
    """One tree that looks at a random part of the features at each split."""
    return _fit(train, features, y, RandomForestRegressor(
        numTrees=1, bootstrap=False, featureSubsetStrategy=subset,
        maxDepth=tree_depth(max_depth), seed=seed))


def fit_forest(train: DataFrame, features: Sequence[str], y: str, num_trees: int = 100, max_depth: int | None = 10,
               min_instances: int = 1, subset: str = "all", seed: int = 42) -> Fitted:
    return _fit(train, features, y, RandomForestRegressor(
        numTrees=num_trees, featureSubsetStrategy=subset, minInstancesPerNode=min_instances,
        maxDepth=tree_depth(max_depth), seed=seed))


def fit_boosted(train: DataFrame, features: Sequence[str], y: str, max_iter: int = 50, max_depth: int = 5,
                step_size: float = 0.1, seed: int = 42) -> Fitted:
    return _fit(train, features, y, GBTRegressor(maxIter=max_iter, maxDepth=tree_depth(max_depth), stepSize=step_size, seed=seed))


@dataclass
class MultiOutput:
    """One linear model a step, all from the same pass over the data."""

    fits: list[LinearFit]

    def columns(self, out: str = "step") -> dict:
        return {f"{out}_{i + 1}": fit.column() for i, fit in enumerate(self.fits)}

    def transform(self, df: DataFrame, out: str = "step") -> DataFrame:
        return df.select("*", *[c.alias(n) for n, c in self.columns(out).items()])


def fit_multi_output(train: DataFrame, features: Sequence[str], targets: Sequence[str], kind: str = "ridge",
                     **params) -> MultiOutput:
    """A model per target over the same features; the sums of all targets come from one pass."""
    cols = [*features, *targets]
    gram = gram_blocks(train.withColumn("_one", F.lit(0)), cols[:-1], cols[-1], "_one", targets)[0]
    inputs = list(range(len(features)))
    return MultiOutput([fit_from_gram(gram.take([*inputs, len(features) + t]), features, kind, params)
                        for t in range(len(targets))])


def fit_seasonal_naive(train: DataFrame, s: Sequence[str], o: str, y: str, horizon: int, period: int = 52,
                       max_rows: int | None = None) -> DataFrame:
    """Forecast rows ``(series, horizon, prediction)`` repeating the last ``period`` values.

    A value knows the horizons it serves, so nothing is joined.
    """
    numbered = number_rows(train.select(*s, o, y), s, o, max_rows)
    season = F.least(F.lit(period), F.col(LEN))
    phase = F.col(POS) - (F.col(LEN) - season) + 1
    tail = numbered.withColumns({"_phase": phase, "_season": season}).filter(F.col("_phase").between(1, horizon))
    served = F.sequence(F.col("_phase"), F.lit(horizon).cast("long"), F.col("_season").cast("long"))
    out = tail.select(*s, F.explode(served).alias("horizon"), F.col(y).alias("prediction"))
    return out.withColumn("horizon", F.col("horizon").cast("int"))


def _rates(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a level rate and a trend rate."""
    rates = np.linspace(0.1, 0.9, steps)
    a, b = (m.ravel() for m in np.meshgrid(rates, np.concatenate([[0.0], rates])))
    return a, b


def _advance(values: np.ndarray, steps: int, level: np.ndarray, trend: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run the recursion of every rate pair over ``values``.

    Level and trend are rows of coefficients, one row a rate pair, of what is not known yet; the last one is
    the constant. Returns both in that form, (pairs, 2, n), and the errors' sum of products, (pairs, n, n).
    """
    a, b = (m[:, None] for m in _rates(steps))
    constant = np.zeros(level.shape[1])
    constant[-1] = 1.0
    cost = np.zeros((len(a), level.shape[1], level.shape[1]))
    for start in range(0, len(values), 256):
        part = values[start:start + 256]
        errors = np.empty((len(part), *level.shape))
        for i, value in enumerate(part):
            ahead = level + trend
            errors[i] = value * constant - ahead
            new = a * value * constant + (1 - a) * ahead
            trend = b * (new - level) + (1 - b) * trend
            level = new
        cost += np.einsum("nki,nkj->kij", errors, errors)
    return np.stack([level, trend], axis=1), cost


def _compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two neighbouring pieces as one: maps chain, the later errors are rewritten in the earlier piece's unknowns."""
    (move, cost), (later, later_cost) = first, then
    n = move.shape[2]
    constant = np.zeros((len(move), 1, n))
    constant[:, 0, -1] = 1.0
    entry = np.concatenate([move, constant], axis=1)
    return later @ entry, cost + entry.transpose(0, 2, 1) @ later_cost @ entry


def fit_expsmooth(train: DataFrame, s: Sequence[str], o: str | Sequence[str], y: str, horizon: int, max_rows: int | None = None,
                  piece_rows: int = 10_000, fan: int = 64, steps: int = 9) -> DataFrame:
    """Exponential smoothing with trend, a fit per series; rows ``(series, horizon, prediction)``.

    For fixed rates a run of points maps (level, trend) affinely, and its squared error is a quadratic form
    of them. So a long series is worked off in pieces of ``piece_rows`` points side by side, and neighbouring
    pieces are composed, ``fan`` at a time, until one a series is left. The first piece knows its state, so
    a series of one piece is an ordinary run. The rate pair with the smallest error forecasts. Points
    without a value are left out; rows of one time are ordered by value. ``max_rows`` is that of `number_rows`.
    """
    x = F.nanvl(F.col(f"`{y}`").cast("double"), F.lit(None).cast("double"))
    known = train.select(*s, *names(o), x.alias("_x")).filter("_x IS NOT NULL")
    fields = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    keys, order = [f"`{c}` {fields[c]}" for c in s], [*names(o), "_x"]
    cut = number_rows(known, s, order, max_rows).select(*s, "_x", POS, LEN, F.floor(F.col(POS) / piece_rows).alias("_part"))
    pairs = len(_rates(steps)[0])
    schema = ", ".join([*keys, "_part long", f"{LEN} long", "move array<double>", "cost array<double>"])

    def row(pdf: pd.DataFrame, part: int, move: np.ndarray, cost: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{c: pdf[c].iloc[:1].to_numpy() for c in s}, "_part": [part], LEN: pdf[LEN].iloc[:1].to_numpy(),
                             "move": [move.ravel()], "cost": [cost.ravel()]})

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(POS)["_x"].to_numpy(dtype=float)
        part = int(pdf["_part"].iloc[0])
        # The first piece enters with its first value and no trend; the others with both unknown.
        entry = np.array([[values[0]], [0.0]]) if part == 0 else np.eye(2, 3)
        level, trend = (np.repeat(e[None], pairs, axis=0) for e in entry)
        return row(pdf, part, *_advance(values, steps, level, trend))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for move, cost in pdf.sort_values("_part")[["move", "cost"]].itertuples(index=False):
            move = np.asarray(move).reshape(pairs, 2, -1)
            piece = move, np.asarray(cost).reshape(pairs, move.shape[2], -1)
            total = piece if total is None else _compose(total, piece)
        return row(pdf, int(pdf["_part"].min()) // fan, *total)

    done = settle(cut.groupBy(*s, "_part").applyInPandas(summarise, schema))
    last = done.agg(F.max("_part")).first()[0] or 0
    whole, open_ = done.filter(F.col(LEN) <= piece_rows), done.filter(F.col(LEN) > piece_rows)
    while last > 0:
        open_ = settle(open_.groupBy(*s, F.floor(F.col("_part") / fan).alias("_group")).applyInPandas(merge, schema))
        last //= fan
    best = F.array_position("cost", F.array_min("cost")).cast("int")
    state = whole.unionByName(open_).select(*s, F.element_at("move", 2 * best - 1).alias("_level"), F.element_at("move", 2 * best).alias("_trend"))
    ahead = state.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select(*s, "horizon", (F.col("_level") + F.col("horizon") * F.col("_trend")).alias("prediction"))
