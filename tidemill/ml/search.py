"""Search over parameters, folds, scalers, scorers, models and lags.

Linear models are searched on Gram sums: one pass per feature frame serves every fold, draw, scaler and correlation scorer. Quantiles, joint counts and forests of all folds take one pass each (a pass a
level for trees). Models that are neither linear nor trees are fits of their own, each distributed by itself; the
driver only walks the list of configurations.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.metrics import met_mse, met_r2
from tidemill.ml import registry
from tidemill.ml.gram import Gram, LinearFit, Problem, correlations, errors_many, fit_from_gram, gram_blocks, scaler_vectors, solve_many
from tidemill.ml.histograms import Bins, joint_counts, mutual_information
from tidemill.ml.trees import TreeModel, bin_rows, doubles, fold_errors, grow, importances
from tidemill.operators.evaluate import score_pairs
from tidemill.operators.layout import join_null_safe
from tidemill.operators.reshape import set_union_results
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.scale import USER_KINDS, ScalerParams, apply_scaler, fit_scaler, robust_affine, scaled, uniform_place
from tidemill.operators.score import score_importance, score_mi
from tidemill.session import settle

SUM_SCALERS = ("none", "minmax", "standard")
SUM_SCORERS = ("F_regression", "Pearson Correlation", "No scoring")

RECORD_SCHEMA = (
    "target string, model string, lag int, scaler string, scorer string, execution_time double, "
    "mean_train_mse double, mean_test_mse double, cv_r2 double, "
    "selected array<string>, params map<string,string>, error string")
TEST_ERRORS = ["mape", "mae", "medae", "me", "mse", "rmse", "r2"]


ALL = 1 << 20  # stands for "all rows" among the numbers of folds
FOLD_KEYS = 1 << 10  # keys of one fold in sums over rows scaled for each fold


@dataclass
class Folds:
    """A train frame with its ``block`` column and what has been worked out on it so far, for all folds at once.

    Every kind of number takes one pass over the rows, whatever the folds: Gram sums and joint counts add up over
    blocks, quantiles are grouped by fold, rows scaled by quantiles are summed for each fold in the same pass, and the
    forests of all folds grow together.
    """

    train: DataFrame
    features: list[str]
    y: str
    n_splits: int = 5
    n_quantiles: int = 1000
    kinds: tuple[str, ...] = ()
    _grams: dict[str, Any] = field(default_factory=dict)
    _sums: dict[tuple, Gram] = field(default_factory=dict)
    _chosen: dict[tuple, list[int]] = field(default_factory=dict)
    _scalers: dict[tuple, ScalerParams] = field(default_factory=dict)
    _quantiles: dict[tuple, dict[str, list[float]]] | None = None
    _counts: dict[int, np.ndarray] | None = None
    _importance: dict[int | None, np.ndarray] | None = None
    _binned: Any = None

    @property
    def raw(self) -> dict[int, Gram]:
        if "raw" not in self._grams:
            self._grams["raw"] = gram_blocks(self.train, self.features, self.y)
        return self._grams["raw"]

    @property
    def binned(self):
        if self._binned is None:
            self._binned = bin_rows(self.train, self.features, self.y, "block")
        return self._binned

    def usable(self) -> list[int]:
        return [i for i in range(1, self.n_splits + 1) if i in self.raw and any(b < i for b in self.raw)]

    def part(self, fold: int | None) -> DataFrame:
        """Train rows of a fold; None for all rows."""
        return self.train if fold is None else self.train.filter(F.col("block") < fold)

    def _tables(self) -> dict[tuple, dict[str, list[float]]]:
        """(kind, fold) -> quantiles by feature, for the robust and the quantile scaler, from one grouping by fold."""
        if self._quantiles is None:
            folds = [*self.usable(), ALL]
            inside = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: F.col("block") < f)
            rows = self.train.select(F.explode(inside).alias("fold"), *[F.col(f"`{c}`") for c in self.features])
            sizes = {r[0]: r[1] for r in rows.groupBy("fold").count().collect()}
            grids = {f: list(np.linspace(0, 1, max(2, min(self.n_quantiles, sizes.get(f, 0))))) if "quantile" in self.kinds else [] for f in folds}
            robust = [0.25, 0.5, 0.75]
            probs = sorted({p for g in grids.values() for p in g} | set(robust))
            at = {p: i for i, p in enumerate(probs)}
            places = {f: np.array([at[p] for p in g], dtype=int) for f, g in grids.items()}
            self._quantiles = {(kind, f): {} for f in folds for kind in ("robust", "quantile")}
            for r in exact_quantiles(rows, self.features, probs, ["fold"]).select("fold", "column_name", "quantiles").collect():
                q = np.array(r[2])
                self._quantiles["robust", r[0]][r[1]] = q[[at[p] for p in robust]].tolist()
                self._quantiles["quantile", r[0]][r[1]] = q[places[r[0]]].tolist()
        return self._quantiles

    def scaler(self, kind: str, fold: int | None) -> ScalerParams:
        key = (kind, fold)
        if key not in self._scalers:
            if kind not in self.kinds:
                self.kinds, self._quantiles = (*self.kinds, kind), self._quantiles if kind != "quantile" else None
            if kind == "robust":
                table = self._tables()[kind, ALL if fold is None else fold]
                self._scalers[key] = ScalerParams(kind, {f: robust_affine(table.get(f)) for f in self.features})
            elif kind == "quantile":
                self._scalers[key] = ScalerParams(kind, tables=self._tables()[kind, ALL if fold is None else fold])
            else:
                self._scalers[key] = fit_scaler(self.part(fold), self.features, kind)
        return self._scalers[key]

    def blocks(self, kind: str, fold: int | None) -> dict[int, Gram]:
        """Gram blocks on scaled rows. Affine scalers share the blocks of the raw rows."""
        if kind != "quantile":
            return self.raw
        if kind not in self._grams:
            folds = [*self.usable(), ALL]
            tables = {f: [self.scaler(kind, None if f == ALL else f).tables.get(c) for c in self.features] for f in folds}

            def versions(blocks: np.ndarray, values: np.ndarray):
                for i, f in enumerate(folds):
                    mine = blocks <= f
                    moved = values[mine].copy()
                    for j, table in enumerate(tables[f]):
                        if table is not None:
                            moved[:, j] = uniform_place(table, moved[:, j])
                    yield i * FOLD_KEYS + blocks[mine], moved

            got = gram_blocks(self.train, self.features, self.y, versions=versions)
            self._grams[kind] = {f: {k % FOLD_KEYS: g for k, g in got.items() if k // FOLD_KEYS == i} for i, f in enumerate(folds)}
        return self._grams[kind][ALL if fold is None else fold]

    def gram(self, kind: str, fold: int | None) -> Gram:
        key = (kind == "quantile", fold)
        if key not in self._sums:
            blocks = self.blocks(kind, fold)
            parts = [g for b, g in blocks.items() if fold is None or b < fold]
            self._sums[key] = sum(parts[1:], parts[0])
        return self._sums[key]

    def around(self, kind: str, fold: int, held: bool) -> tuple[Gram, tuple]:
        """Sums of a fold's train rows or its held block, and those around the train rows' means."""
        key = ("around", kind == "quantile", fold, held)
        if key not in self._sums:
            train = self.gram(kind, fold)
            g = self.blocks(kind, fold)[fold] if held else train
            self._sums[key] = (g, g.around(train.mean))
        return self._sums[key]

    def scores(self, scorer: str, kind: str, fold: int | None) -> np.ndarray:
        """Scores that do not depend on an affine scaler. Cut points are those of all train rows, so counts add up over blocks."""
        moved = kind == "quantile"
        if scorer in SUM_SCORERS:
            return np.abs(correlations(self.gram(kind, fold)))
        if registry.SCORERS[scorer] is score_mi:
            if self._counts is None:
                whole = self.gram("none", None)
                low, high = whole.low(), whole.high()
                sets = [[Bins(float(a), float(b)) for a, b in zip(low, high)]]
                if "quantile" in self.kinds:
                    # equal-width bins of the scaled values
                    inner = np.linspace(0, 1, 11)[1:-1]
                    tables = self.scaler("quantile", None).tables
                    sets.append([Bins(cuts=tuple(np.interp(inner, np.linspace(0, 1, len(tables[f])), tables[f]))) if f in tables else Bins() for f in self.features])
                ends = whole.lo[-1] + whole.origin[-1], whole.hi[-1] + whole.origin[-1]
                self._counts = joint_counts(self.train, self.features, self.y, sets, Bins(*map(float, ends)), "block")
            parts = [c for b, c in self._counts.items() if fold is None or b < fold]
            return mutual_information(sum(parts[1:], parts[0])[1 if moved and len(parts[0]) > 1 else 0])
        if registry.SCORERS[scorer] is score_importance:
            # trees cut at quantiles, which a scaler of single features does not move
            if self._importance is None:
                self._importance = importances(self.binned, [*self.usable(), None])
            return self._importance[fold]
        rows = self.part(fold)
        if moved:
            rows = apply_scaler(rows, self.features, self.scaler(kind, fold))
        found = {r[0]: r[1] for r in registry.SCORERS[scorer](rows, self.features, self.y).collect()}
        return np.array([found[f] if found.get(f) is not None else -np.inf for f in self.features])

    def choose(self, scorer: str, kind: str, fold: int | None) -> list[int]:
        """Places of the features the scorer keeps."""
        if registry.SCORERS[scorer] is None:
            return list(range(len(self.features)))
        key = (scorer, fold, kind == "quantile")
        if key not in self._chosen:
            k = min(registry.K_VALUES.get(scorer, 5), len(self.features))
            r = np.nan_to_num(self.scores(scorer, kind, fold), nan=-np.inf, posinf=np.inf)
            self._chosen[key] = sorted(sorted(range(len(r)), key=lambda i: (-r[i], self.features[i]))[:k])
        return self._chosen[key]

    def names(self, places: Sequence[int]) -> list[str]:
        return [self.features[i] for i in places]


@dataclass
class Outcome:
    params: dict[str, Any]
    r2: float
    train_mse: float
    test_mse: float
    selected: list[str]
    predict: Callable[[DataFrame], DataFrame]
    # The fit on raw features, or on features scaled by quantiles, where the model is linear in them.
    fit: LinearFit | None = None


def _scale(folds: Folds, kind: str, fold: int | None) -> np.ndarray:
    if kind == "robust" or kind in USER_KINDS:
        affine = folds.scaler(kind, fold).affine
        return np.array([affine[f][1] for f in folds.features])
    return scaler_vectors(folds.gram(kind, fold), kind if kind in SUM_SCALERS else "none")[1]


def _coefficients(folds: Folds, spec: registry.ModelSpec, kind: str, scorer: str, fold_ids: Sequence[int | None],
                  draws: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per fold the coefficients (draw, feature) on unscaled features and the intercepts; all folds and draws are solved together."""
    problems, kept = [], []
    for fold in fold_ids:
        g, chosen, scale = folds.gram(kind, fold), np.asarray(folds.choose(scorer, kind, fold), dtype=int), _scale(folds, kind, fold)
        xx, xy, yy = g.centred()
        sc = scale[chosen]
        problems.append(Problem(xx[np.ix_(chosen, chosen)] / np.outer(sc, sc), xy[chosen] / sc, yy, g.n))
        kept.append((g, chosen, sc))
    out = []
    for (g, chosen, sc), beta in zip(kept, solve_many(spec.gram, problems, draws)):
        coef = np.zeros((len(draws), len(folds.features)))
        coef[:, chosen] = beta / sc
        out.append((coef, g.y_mean - coef @ g.mean))
    return out


def search_linear(folds: Folds, spec: registry.ModelSpec, scaler: str, scorer: str, draws: list[dict]) -> tuple[Outcome, list[dict]]:
    kind = registry.SCALERS[scaler]
    usable = folds.usable()
    r2, train_mse, test_mse = (np.zeros((len(draws), len(usable))) for _ in range(3))
    found = _coefficients(folds, spec, kind, scorer, [*usable, None], draws)
    for k, (fold, (coef, start)) in enumerate(zip(usable, found)):
        mean = folds.gram(kind, fold).mean
        g, sums = folds.around(kind, fold, True)
        test_mse[:, k], r2[:, k] = errors_many(g, mean, coef, start, sums)
        g, sums = folds.around(kind, fold, False)
        train_mse[:, k], _ = errors_many(g, mean, coef, start, sums)
    records = [{"params": params, "r2": float(r2[i].mean()) if usable else float("nan"), "train_mse": float(train_mse[i].mean()) if usable else float("nan"),
                "test_mse": float(test_mse[i].mean()) if usable else float("nan"), "fold_r2": r2[i].tolist()} for i, params in enumerate(draws)]
    scored = [i for i, r in enumerate(records) if r["r2"] == r["r2"]]
    if not scored:
        raise ValueError("no fold can be scored: every target is constant or a fold is empty")
    at = max(scored, key=lambda i: records[i]["r2"])
    best, (coef, start) = records[at], found[-1]
    places = folds.choose(scorer, kind, None)
    mean = folds.gram(kind, None).mean
    final = LinearFit(tuple(folds.names(places)), tuple(float(v) for v in coef[at, places]), float(start[at]), tuple(float(v) for v in mean[places]))

    def predict(df: DataFrame) -> DataFrame:
        if kind != "quantile":
            return final.transform(df, "y_pred")
        # The fit stands on scaled features; the raw ones stay in the frame under their names.
        params = folds.scaler(kind, None)
        moved = df.select("*", *[scaled(params, f).alias(f"_q_{f}") for f in final.features])
        column = LinearFit(tuple(f"_q_{f}" for f in final.features), final.coef, final.intercept, final.fill).column()
        return moved.withColumn("y_pred", column).drop(*[f"_q_{f}" for f in final.features])

    selected = [] if registry.SCORERS[scorer] is None else list(final.features)
    return Outcome(best["params"], best["r2"], best["train_mse"], best["test_mse"], selected, predict, final), records


def search_trees(folds: Folds, spec: registry.ModelSpec, scaler: str, scorer: str, draws: list[dict], seed: int = 42) -> tuple[Outcome, list[dict]]:
    """The same search with trees: those of all folds and draws grow in one pass a level and are judged in one more.

    Trees cut at quantiles of the raw rows, so a scaler, which keeps the order of a feature's values, changes nothing."""
    kind, usable = registry.SCALERS[scaler], folds.usable()
    chosen = {f: tuple(folds.choose(scorer, kind, f)) for f in [*usable, None]}
    lots = [(fold, i, spec.jobs(params, fold, chosen[fold], seed)) for fold in usable for i, params in enumerate(draws)]
    trees = iter(grow(folds.binned, [j for _, _, jobs in lots for j in jobs]))
    fits = [(fold, [next(trees) for _ in jobs]) for fold, _, jobs in lots]
    scores = dict(zip([(fold, i) for fold, i, _ in lots], fold_errors(folds.binned, fits)))
    records = []
    for i, params in enumerate(draws):
        mine = [scores[f, i] for f in usable]
        r2, train_mse, test_mse = (float(np.mean(c)) for c in zip(*mine)) if mine else (float("nan"),) * 3
        records.append({"params": params, "r2": r2, "train_mse": train_mse, "test_mse": test_mse, "fold_r2": [m[0] for m in mine]})
    best = max(records, key=lambda r: r["r2"] if r["r2"] == r["r2"] else float("-inf"))
    model = TreeModel(tuple(folds.features), folds.binned.cuts, folds.binned.fill, grow(folds.binned, spec.jobs(best["params"], None, chosen[None], seed)))
    selected = [] if registry.SCORERS[scorer] is None else folds.names(chosen[None])
    return Outcome(best["params"], best["r2"], best["train_mse"], best["test_mse"], selected, lambda df: model.transform(df, "y_pred")), records


def _fit_any(spec: registry.ModelSpec, rows: DataFrame, features: list[str], y: str, params: dict, key: str | None):
    if spec.name == "KNeighborsRegressor":
        return spec.fit(rows, features, y, key, **params)
    return spec.fit(rows, features, y, **params)


def _apply(model, df: DataFrame, key: str | None) -> DataFrame:
    return model.transform(df, key, "y_pred") if key is not None and hasattr(model, "neighbours") else model.transform(df, "y_pred")


def search_fitted(folds: Folds, spec: registry.ModelSpec, scaler: str, scorer: str, draws: list[dict],
                  key: str | None = None) -> tuple[Outcome, list[dict]]:
    """The same search with MLlib fits: rows of a fold are chosen by filters on ``block``."""
    kind = registry.SCALERS[scaler]
    records = []
    present = {r[0] for r in folds.train.select("block").distinct().collect()}
    for params in draws:
        scores = []
        for i in (i for i in range(1, folds.n_splits + 1) if i in present):
            chosen = folds.names(folds.choose(scorer, kind, i))
            rows = apply_scaler(folds.train.filter(F.col("block") <= i), folds.features, folds.scaler(kind, i))
            model = _fit_any(spec, rows.filter(F.col("block") < i), chosen, folds.y, params, key)
            scored = _apply(model, rows, key).groupBy((F.col("block") == i).alias("held")).agg(
                met_mse(folds.y, "y_pred").alias("mse"), met_r2(folds.y, "y_pred").alias("r2"))
            got = {r["held"]: r for r in scored.collect()}
            scores.append((got[True]["r2"], got[False]["mse"], got[True]["mse"]))
        r2, train_mse, test_mse = (float(np.mean([float("nan") if v is None else v for v in col])) for col in zip(*scores))
        records.append({"params": params, "r2": r2, "train_mse": train_mse, "test_mse": test_mse,
                        "fold_r2": [s[0] for s in scores]})
    best = max(records, key=lambda r: r["r2"] if r["r2"] == r["r2"] else float("-inf"))
    chosen = folds.names(folds.choose(scorer, kind, None))
    params_all = folds.scaler(kind, None)
    model = _fit_any(spec, apply_scaler(folds.train, folds.features, params_all), chosen, folds.y, best["params"], key)

    def predict(df: DataFrame) -> DataFrame:
        return _apply(model, apply_scaler(df, folds.features, params_all), key)

    selected = [] if registry.SCORERS[scorer] is None else chosen
    return Outcome(best["params"], best["r2"], best["train_mse"], best["test_mse"], selected, predict), records


def _search(folds: Folds, spec: registry.ModelSpec, scaler: str, scorer: str, draws: list[dict], seed: int, key: str | None) -> tuple[Outcome, list[dict]]:
    if spec.gram:
        return search_linear(folds, spec, scaler, scorer, draws)
    if spec.jobs:
        return search_trees(folds, spec, scaler, scorer, draws, seed)
    return search_fitted(folds, spec, scaler, scorer, draws, key)


def search_grid(train: DataFrame, features: Sequence[str], y: str, model: str, space: registry.Space | None = None,
                n_iter: int = 30, n_splits: int = 5, seed: int = 42, scaler: str = "No scaling",
                scorer: str = "No scoring", key: str | None = None) -> tuple[Outcome, DataFrame]:
    """Best draw by mean R2 over the folds in ``train.block``, refitted on all rows; and all records."""
    spec = registry.MODELS[model]
    draws = registry.draw_params(spec.space if space is None else space, n_iter, seed)
    if not spec.gram:
        # Every fit reads the rows several times.
        train = settle(train)
    folds = Folds(train, list(features), y, n_splits, kinds=(registry.SCALERS[scaler],))
    outcome, records = _search(folds, spec, scaler, scorer, draws, seed, key)
    rows = [(model, i, json.dumps(r["params"], sort_keys=True), r["r2"], r["train_mse"], r["test_mse"])
            for i, r in enumerate(records)]
    frame = train.sparkSession.createDataFrame(
        rows, "model string, draw int, params string, cv_r2 double, train_mse double, test_mse double")
    return outcome, frame


def cv_predict(train: DataFrame, features: Sequence[str], y: str, model: str, params: dict | None = None,
               n_splits: int = 5, key: str | None = None) -> DataFrame:
    """Out-of-fold predictions: every row of a tested block with the fit of the blocks before it."""
    spec, features = registry.MODELS[model], list(features)
    present = {r[0] for r in train.select("block").distinct().collect()}
    fold_ids = [i for i in range(1, n_splits + 1) if i in present]
    if spec.gram:
        # All folds share one pass; each row takes the coefficients of its own block.
        folds = Folds(train, features, y, n_splits)
        fits = {i: fit_from_gram(folds.gram("none", i), features, spec.gram, params or {}) for i in fold_ids}
        pred = F.lit(None).cast("double")
        for i, fit in fits.items():
            pred = F.when(F.col("block") == i, fit.column()).otherwise(pred)
        return train.filter(F.col("block") >= 1).withColumn("y_pred", pred)
    train, parts = settle(train), []
    for i in fold_ids:
        fitted = _fit_any(spec, train.filter(F.col("block") < i), features, y, params or {}, key)
        parts.append(_apply(fitted, train.filter(F.col("block") == i), key))
    return set_union_results(parts)


def cv_report(predictions: DataFrame, y: str, by: str = "block") -> DataFrame:
    """Squared error and R2 per fold."""
    return predictions.groupBy(by).agg(F.count(F.lit(1)).alias("n"), met_mse(y, "y_pred").alias("mse"),
                                       met_r2(y, "y_pred").alias("r2"))


CONFIG = ["model", "lag", "scaler", "scorer"]


def _linear_predictions(test: DataFrame, folds: Folds, y: str, keys: Sequence[str], found: list[tuple[tuple, LinearFit, bool]]) -> DataFrame:
    """All linear configurations of a lag from one scan of its test rows: features times a matrix of coefficients.

    Rows are filled with the means of all train rows, of scaled values for those configurations that stand on quantiles.
    """
    features = folds.features
    places = {f: i for i, f in enumerate(features)}
    sides = []
    for moved in (False, True):
        mine = [(c, fit) for c, fit, m in found if m == moved]
        if mine:
            coef, fill = np.zeros((len(features), len(mine))), np.zeros(len(features))
            for k, (_, fit) in enumerate(mine):
                at = [places[f] for f in fit.features]
                coef[at, k] = fit.coef
                fill[at] = fit.fill
            tables = [folds.scaler("quantile", None).tables.get(f) for f in features] if moved else None
            sides.append(([c for c, _ in mine], coef, np.array([fit.intercept for _, fit in mine]), fill, tables))
    types = {f.name: f.dataType.simpleString() for f in test.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "y_true double", "model string", "lag int", "scaler string", "scorer string", "y_pred double"])
    names = [f"x{i}" for i in range(len(features))]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            heads = pdf[[*keys, "y_true"]]
            for configs, coef, start, fill, tables in sides:
                moved = x if tables is None else np.column_stack([x[:, j] if t is None else uniform_place(t, x[:, j]) for j, t in enumerate(tables)])
                y_pred = np.where(np.isnan(moved), fill, moved) @ coef + start
                out = heads.loc[heads.index.repeat(len(configs))].reset_index(drop=True)
                for name, column in zip(CONFIG, zip(*configs)):
                    out[name] = np.tile(np.array(column, dtype=object), len(x))
                out["lag"] = out["lag"].astype("int32")
                out["y_pred"] = y_pred.ravel()
                yield out

    # one configuration more is one row more a test row: a batch holds few test rows
    return test.select(*keys, F.col(y).cast("double").alias("y_true"), *doubles(features)).mapInPandas(predict, schema)


def _search_lag(lag: int, train: DataFrame, test: DataFrame, features: list[str], y: str, models: Sequence[str], scalers: Sequence[str],
                scorers: Sequence[str], keys: Sequence[str], n_iter: int, n_splits: int, seed: int, key: str | None, n_quantiles: int) -> tuple[list, list]:
    records, parts = [], []
    folds = Folds(train, features, y, n_splits, n_quantiles, tuple(registry.SCALERS[s] for s in scalers))
    linear: list[tuple[tuple, LinearFit, bool]] = []
    for name, scaler, scorer in product(models, scalers, scorers):
        spec, config = registry.MODELS[name], (name, lag, scaler, scorer)
        start = time.monotonic()
        try:
            outcome, _ = _search(folds, spec, scaler, scorer, registry.draw_params(spec.space, n_iter, seed), seed, key)
            if outcome.fit is not None:
                linear.append((config, outcome.fit, registry.SCALERS[scaler] == "quantile"))
            else:
                parts.append(outcome.predict(test).select(
                    *keys, F.col(y).cast("double").alias("y_true"), *[F.lit(v).alias(n) for n, v in zip(CONFIG, config)], "y_pred"))
            records.append((y, *config, time.monotonic() - start, outcome.train_mse, outcome.test_mse, outcome.r2,
                            outcome.selected, {k: str(v) for k, v in outcome.params.items()}, None))
        except Exception as e:  # noqa: BLE001 - any failure of a configuration is a record
            records.append((y, *config, None, None, None, None, None, None, str(e)))
    if linear:
        parts.append(_linear_predictions(test, folds, y, keys, linear))
    return records, parts


def side_by_side(fn: Callable, items: Sequence, most: int = 4) -> list:
    """Independent jobs submitted from a bounded pool, so that one's driver work and another's tasks overlap."""
    with ThreadPoolExecutor(max(1, min(most, len(items)))) as pool:
        return list(pool.map(fn, items))


def search_matrix(frames: dict[int, tuple[DataFrame, DataFrame]], features: dict[int, list[str]], y: str,
                  models: Sequence[str], scalers: Sequence[str], scorers: Sequence[str], keys: Sequence[str],
                  n_iter: int = 30, n_splits: int = 5, seed: int = 42, key: str | None = None,
                  n_quantiles: int = 1000) -> tuple[DataFrame, DataFrame | None]:
    """Every model x lag x scaler x scorer; lags are searched side by side.

    ``frames`` holds a train frame (with ``block``) and a test frame per lag. A failing configuration
    becomes a record with its error. Returns the records and the test predictions in long form; the
    test errors of all configurations come from one aggregation over those.
    """
    spark = next(iter(frames.values()))[0].sparkSession
    done = side_by_side(lambda lag: _search_lag(lag, *frames[lag], features[lag], y, models, scalers, scorers, keys, n_iter, n_splits, seed, key,
                                                n_quantiles), list(frames))
    records, parts = [r for some, _ in done for r in some], [p for _, some in done for p in some]
    results = spark.createDataFrame(records, RECORD_SCHEMA)
    # Settled: the errors, the best choice and the horizons all read them.
    predictions = settle(set_union_results(parts)) if parts else None
    if predictions is None:
        empty = [F.lit(None).cast("double").alias(c) for c in TEST_ERRORS]
        return results.select("*", *empty), None
    scores = score_pairs(predictions, CONFIG).select(*CONFIG, *TEST_ERRORS)
    return join_null_safe(results, scores, CONFIG, "left"), predictions
