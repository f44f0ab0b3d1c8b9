"""Registries users add to: models with their parameter spaces, scorers, scalers."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from tidemill.ml import knn, models
from tidemill.ml.trees import Job, subset_size
from tidemill.operators import scale, score


@dataclass(frozen=True)
class Uniform:
    """Even on ``[low, low + width]``."""

    low: float
    width: float

    def draw(self, rng: random.Random) -> float:
        return self.low + self.width * rng.random()


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


Space = dict[str, Sequence[Any] | Uniform | LogUniform]


@dataclass(frozen=True)
class ModelSpec:
    """``gram`` names a solver that works from Gram sums; ``fit`` is any ``fit_*`` function.

    ``jobs(params, fold, features, seed)`` gives the trees of a model that is made of trees."""

    name: str
    fit: Callable
    space: Space = field(default_factory=dict)
    gram: str | None = None
    jobs: Callable[[dict, int | None, tuple[int, ...], int], list[Job]] | None = None


def _trees(n: int = 1, bootstrap: bool = False, random_cut: bool = False):
    def jobs(params: dict, fold: int | None, features: tuple[int, ...], seed: int) -> list[Job]:
        depth = models.tree_depth(params.get("max_depth"))
        return [Job(fold, seed * 1_000 + k, depth, params.get("min_instances", 1), subset_size(params.get("subset"), len(features)), features, bootstrap,
                    random_cut) for k in range(params.get("num_trees", n))]
    return jobs


def draw_params(space: Space, n_iter: int, seed: int) -> list[dict[str, Any]]:
    """Seeded draws; spaces made of lists only are drawn without repeats, all of them if fewer."""
    rng = random.Random(seed)
    if not space:
        return [{}]
    if all(not hasattr(v, "draw") for v in space.values()):
        grid = [dict(zip(space, values)) for values in product(*space.values())]
        return grid if len(grid) <= n_iter else rng.sample(grid, n_iter)
    return [{k: v.draw(rng) if hasattr(v, "draw") else rng.choice(list(v)) for k, v in space.items()}
            for _ in range(n_iter)]


# Model names and the parameter values searched over. Settings that only steer another
# library's solver have no counterpart here and are left out; depth is at most 30.
MODELS: dict[str, ModelSpec] = {m.name: m for m in (
    ModelSpec("BayesianRidge", models.fit_bayesridge, {
        "tol": Uniform(1e-2, 1e-4),
        "alpha_1": Uniform(1e-5, 1e-7),
        "alpha_2": Uniform(1e-5, 1e-7),
        "lambda_1": Uniform(1e-5, 1e-7),
        "lambda_2": Uniform(1e-5, 1e-7),
    }, gram="bayesridge"),
    ModelSpec("DecisionTreeRegressor", models.fit_tree, {
        "max_depth": [None, 10, 20, 30],
        "min_instances": [1, 2, 5],
    }, jobs=_trees()),
    ModelSpec("ExtraTreeRegressor", models.fit_extratree, {
        "max_depth": [8, 16, None],
        "subset": ["all", "sqrt", "log2"],
    }, jobs=_trees(random_cut=True)),
    ModelSpec("KNeighborsRegressor", knn.fit_knn, {
        "n_neighbors": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
        "weights": ["uniform", "distance"],
        "p": [2, 3, 4],
    }),
    ModelSpec("Lasso", models.fit_lasso, {
        "alpha": [0.2, 0.4, 0.6, 0.8, 1.0],
        "tol": [1e-2, 1e-3, 1e-4],
    }, gram="lasso"),
    ModelSpec("ElasticNet", models.fit_elasticnet, {
        "alpha": [0.2, 0.4, 0.6, 0.8, 1.0],
        "l1_ratio": [0.5],
    }, gram="elasticnet"),
    ModelSpec("LinearRegression", models.fit_linear, {}, gram="linear"),
    ModelSpec("RandomForestRegressor", models.fit_forest, {
        "num_trees": [50, 100, 200, 300, 400],
        "subset": ["sqrt", "log2", "all", "0.5"],
        "max_depth": [None, 16],
        "min_instances": [1, 5, 10],
    }, jobs=_trees(100, bootstrap=True)),
    ModelSpec("GradientBoosting", models.fit_boosted, {
        "max_iter": [20, 50],
        "max_depth": [3, 5],
    }),
    ModelSpec("Ridge", models.fit_ridge, {
        "alpha": [0.2, 0.4, 0.6, 0.8, 1.0],
    }, gram="ridge"),
)}

SCORERS = dict(score.SCORERS)
K_VALUES = dict(score.K_VALUES)

# Scaler names in search order.
SCALERS: dict[str, str] = {
    "MinMaxScaler": "minmax",
    "StandardScaler": "standard",
    "RobustScaler": "robust",
    "QuantileTransformer": "quantile",
    "No scaling": "none",
}


def register_model(spec: ModelSpec) -> None:
    MODELS[spec.name] = spec


def register_scorer(name: str, fn: score.Scorer, k: int = score.DEFAULT_K) -> None:
    """``fn(df, features, y)`` gives rows ``(feature, score)``."""
    SCORERS[name] = fn
    K_VALUES[name] = k
    score.SCORERS[name] = fn
    score.K_VALUES[name] = k


def register_scaler(name: str, kind: str | Callable) -> None:
    """Under ``name``: a built-in kind, or ``fit(df, cols)`` giving ``{column: (shift, scale)}``."""
    if callable(kind):
        scale.USER_KINDS[name] = kind
        kind = name
    elif kind not in scale.BUILT_IN:
        raise KeyError(f"unknown scaler kind: {kind}")
    SCALERS[name] = kind


def unregister_scaler(name: str) -> None:
    SCALERS.pop(name, None)
    scale.USER_KINDS.pop(name, None)


def fit_named_scaler(df, cols, name: str, **kw) -> scale.ScalerParams:
    return scale.fit_scaler(df, cols, SCALERS[name], **kw)
