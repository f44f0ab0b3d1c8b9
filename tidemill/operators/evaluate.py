"""Error per horizon, best configuration, leaderboard and chart data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.metrics import met_mae, met_mape, met_me, met_mse, met_r2, met_rmse
from tidemill.functions.scalars import abs_error, ape
from tidemill.operators.layout import join_null_safe
from tidemill.operators.quantiles import exact_quantiles


def median_error(pairs: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred", max_rows: int = 5_000_000) -> DataFrame:
    """Median absolute error per group, ``(by.., medae)``, of groups of any size; those without a pair are left out."""
    found = exact_quantiles(pairs.select(*by, abs_error(y, p).alias("_e")), ["_e"], [0.5], by, max_rows)
    return found.select(*by, F.col("quantiles")[0].alias("medae"))


def score_pairs(pairs: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred",
                max_rows: int = 5_000_000) -> DataFrame:
    """All metrics per group. The median is that of `median_error`, so no group is too large."""
    plain = pairs.groupBy(*by).agg(
        F.count(abs_error(y, p)).alias("n"), met_mape(y, p).alias("mape"), met_mae(y, p).alias("mae"),
        met_me(y, p).alias("me"), met_mse(y, p).alias("mse"), met_rmse(y, p).alias("rmse"), met_r2(y, p).alias("r2"))
    medians = median_error(pairs, by, y, p, max_rows)
    if not by:
        return plain.withColumn("medae", medians.scalar())
    return join_null_safe(plain, medians, by, "left")


def met_horizon(pairs: DataFrame, s: Sequence[str], horizon: int, y: str = "y_true", p: str = "y_pred",
                horizon_col: str = "horizon", max_rows: int = 5_000_000) -> DataFrame:
    """Errors per group and horizon 1..``horizon``; horizons past the data give nulls."""
    by = [*s, horizon_col]
    groups = pairs.select(*s).distinct()
    calendar = groups.withColumn(horizon_col, F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    errors = score_pairs(pairs, by, y, p, max_rows).drop("n", "r2", "mape")
    apes = pairs.groupBy(*by).agg(F.avg(ape(y, p)).alias("ape"))
    return join_null_safe(join_null_safe(calendar, errors, by, "left"), apes, by, "left")


def ordinal(col: str, order: Sequence[str]):
    """Place of a name in a given order; names not listed come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
    return F.when(place == 0, len(order) + 1).otherwise(place)


def best_config(results: DataFrame, by: Sequence[str], scalers: Sequence[str], scorers: Sequence[str],
                min_mape: float | None = None) -> DataFrame:
    """Smallest MAPE per group; lag, then scaler, then scorer order settle a tie.

    Error records and NaN never win. ``min_mape=1`` asks for MAPE above 1 as well.
    """
    valid = results.filter(F.col("mape").isNotNull() & ~F.isnan("mape"))
    if min_mape is not None:
        valid = valid.filter(F.col("mape") > min_mape)
    rest = [c for c in results.columns if c not in by]
    rank = F.struct("mape", "lag", ordinal("scaler", scalers), ordinal("scorer", scorers))
    best = valid.groupBy(*by).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])


def leaderboard(best: DataFrame, horizon_metrics: DataFrame, horizon: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """One row per group: overall error, error at the first and last horizon, settings; best first."""
    ends = horizon_metrics.groupBy(*by).agg(
        F.max(F.when(F.col("horizon") == horizon, F.col("ape"))).alias("mape_last"),
        F.max(F.when(F.col("horizon") == 1, F.col("ape"))).alias("mape_first"))
    joined = join_null_safe(best, ends, by, "left")
    cols = ["mape", "mape_last", "mape_first", "mae", "execution_time", "scaler", "scorer", "lag"]
    return joined.select(*by, *cols).orderBy(F.col("mape").asc_nulls_last(), *by)


def chart_pred_frame(actual: DataFrame, pred: DataFrame, s: Sequence[str], date_col: str = "ts",
                     model: str | None = None) -> DataFrame:
    """Long form of actual and predicted lines ``(series, date, label, value)``, shorter length wins."""
    if model is not None:
        pred = pred.filter(F.col("model") == model)
    paired = pred.join(actual, [*s, "horizon"])
    lines = paired.select(*s, date_col, F.col("model").alias("label"), F.col("y_pred").alias("value"))
    truth = paired.select(*s, date_col, F.lit("Actual").alias("label"), F.col("y_true").alias("value")).distinct()
    return truth.unionByName(lines)


def chart_mape_frame(horizon_metrics: DataFrame, dates: DataFrame, s: Sequence[str] = (), model: str | None = None) -> DataFrame:
    """Error by date ``(series.., model, date, ape)``; horizons without a date fall out."""
    if model is not None:
        horizon_metrics = horizon_metrics.filter(F.col("model") == model)
    return horizon_metrics.join(dates, [*s, "horizon"]).select(*s, "model", "ts", "horizon", "ape")
