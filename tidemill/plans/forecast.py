"""Forecast evaluation: features per lag, split, search, selection, leaderboard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import ratio, seasonal_cos
from tidemill.ml import registry
from tidemill.ml.search import search_matrix, side_by_side
from tidemill.operators.clean import check_columns, numeric_columns, proj_dedup_cols
from tidemill.operators.evaluate import best_config, leaderboard, met_horizon
from tidemill.operators.impute import imp_mean
from tidemill.operators.layout import join_null_safe
from tidemill.operators.split import split_tail, split_ts_cv
from tidemill.operators.timeseries import win_expanding_mean, win_lag_features, win_multistep, win_savgol
from tidemill.session import settle
from tidemill.settings import Settings


def new_features(df: DataFrame, s: Sequence[str], o: str, target: str, settings: Settings) -> DataFrame:
    df = proj_dedup_cols(check_columns(df, ["num_suppliers", "litres"], target))
    df = df.withColumns({"yield_per_supplier": ratio("litres", "num_suppliers"), "cos_week": seasonal_cos("Week")})
    return win_expanding_mean(df, s, o, target, max_rows=settings.max_rows)


def preprocess(df: DataFrame, s: Sequence[str], o: str, target: str, lag: int, settings: Settings,
               fit_on=None) -> DataFrame:
    """A pure function of the base frame: each lag starts from the same input.

    ``fit_on`` is a condition that picks the rows whose means fill gaps (the train part).
    """
    numeric = [c for c in numeric_columns(df) if c not in s]
    df = imp_mean(df, numeric, fit_on, by=s)
    if settings.smoothing:
        smooth = [c for c in numeric if c not in (*settings.unsmoothed, target, o)]
        df = win_savgol(
            df, s, o, smooth, settings.smooth_window, 2, short=settings.short_series, max_rows=settings.max_rows) if smooth else df
    df = new_features(df, s, o, target, settings)
    if settings.shifting:
        cols = [c for c in df.columns if c not in (*s, o, "Date", "Week", target)]
        df = win_lag_features(df, s, o, cols, lag, max_rows=settings.max_rows)
    if settings.multi_step:
        df = win_multistep(df, s, o, target, settings.forecast_weeks, max_rows=settings.max_rows)
    return df


def split_data(df: DataFrame, s: Sequence[str], o: str, target: str, settings: Settings) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train rows with their fold block, test rows with their horizon, and the feature names."""
    features = [c for c in numeric_columns(df) if c != target and c not in s]
    tagged = split_tail(df, s, o, settings.forecast_weeks, settings.max_rows)
    train = split_ts_cv(tagged.filter(~F.col("is_test")).drop("is_test", "horizon"), s, o, settings.cv_splits, settings.max_rows)
    return train, tagged.filter("is_test").drop("is_test"), features


@dataclass
class Evaluation:
    results: DataFrame
    predictions: DataFrame
    best: DataFrame
    horizon: DataFrame
    board: DataFrame


def evaluate(df: DataFrame, s: Sequence[str], o: str, target: str, settings: Settings, models: Sequence[str] | None = None,
             scalers: Sequence[str] | None = None, scorers: Sequence[str] | None = None, key: str | None = None,
             n_quantiles: int = 1000) -> Evaluation:
    """The whole evaluation over all series at once."""
    models = list(models or registry.MODELS)
    scalers, scorers = list(scalers or registry.SCALERS), list(scorers or registry.SCORERS)

    def prepared(lag: int) -> tuple[tuple[DataFrame, DataFrame], list[str]]:
        ready = preprocess(df, s, o, target, lag, settings)
        # Settled: the search reads a lag's rows many times.
        train, test, names = split_data(settle(ready), s, o, target, settings)
        return (settle(train), settle(test)), names

    done = dict(zip(settings.lags, side_by_side(prepared, settings.lags)))
    frames, features = {lag: f for lag, (f, _) in done.items()}, {lag: n for lag, (_, n) in done.items()}
    keys = [*s, o, "horizon"]
    results, predictions = search_matrix(frames, features, target, models, scalers, scorers, keys, settings.search_draws,
                                         settings.cv_splits, settings.seed, key, n_quantiles)
    best = best_config(results, ["model"], scalers, scorers)
    if predictions is None:
        # Every configuration failed: the records say why, and there is nothing to rank.
        some = next(iter(frames.values()))[1]
        predictions = some.select(*keys, F.col(target).alias("y_true")).limit(0).select(
            "*", *[F.lit(None).cast(t).alias(c) for c, t in (("model", "string"), ("lag", "int"), ("scaler", "string"), ("scorer", "string"), ("y_pred", "double"))])
    chosen = join_null_safe(predictions, best.select("model", "lag", "scaler", "scorer"), ["model", "lag", "scaler", "scorer"], "left_semi")
    horizon = met_horizon(chosen, ["model"], settings.forecast_weeks)
    return Evaluation(results, predictions, best, horizon, leaderboard(best, horizon, settings.forecast_weeks))
