"""Filling of missing values: means, seasonal means, model predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import settle
from tidemill.operators.layout import join_null_safe, names


def imp_mean(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | Column | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    """Column means in place of nulls.

    ``fit_on`` is the frame, or the row condition on ``df``, that the means come from (a train
    part, so that test rows do not leak); ``by`` takes them per group. Nothing is collected.
    """
    cols = names(cols)
    base = df if fit_on is None else df.filter(fit_on) if isinstance(fit_on, Column) else fit_on
    if by:
        means = base.groupBy(*by).agg(*[F.avg(f"`{c}`").alias(f"_m{i}") for i, c in enumerate(cols)])
        joined = join_null_safe(df, means, by, "left")
        filled = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"_m{i}")) for i, c in enumerate(cols)}
        return joined.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])
    means = base.agg(F.struct(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)])).scalar()
    filled = {c: F.coalesce(F.col(f"`{c}`").cast("double"), means.getField(f"m{i}")) for i, c in enumerate(cols)}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def imp_seasonal(df: DataFrame, target: str, season_col: str, s: Sequence[str] = ()) -> DataFrame:
    """Nulls take the mean of the same season (for instance week of the year) of the series."""
    keys = [*s, season_col]
    means = df.groupBy(*keys).agg(F.avg(target).alias("_season_mean"))
    joined = join_null_safe(df, means, keys, "left")
    return joined.withColumn(target, F.coalesce(F.col(target), F.col("_season_mean"))).drop("_season_mean")


def imp_model(df: DataFrame, target: str | Sequence[str], predictors: Sequence[str], rounds: int = 2,
              seed: int = 42, **forest) -> DataFrame:
    """Nulls take a random forest's prediction from the predictors.

    With several targets each one also serves as a predictor of the others; they start from their
    means and are refined for a fixed number of rounds.
    """
    targets = names(target)
    missing = {t: f"_null_{t}" for t in targets}
    work = df.withColumns({f: F.col(t).isNull() for t, f in missing.items()})
    work = imp_mean(work, targets) if len(targets) > 1 else work
    for _ in range(rounds if len(targets) > 1 else 1):
        for t in targets:
            inputs = [*predictors, *[x for x in targets if x != t]]
            assembler = VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="skip")
            model = RandomForestRegressor(featuresCol="_x", labelCol=t, predictionCol="_p", seed=seed, **forest)
            known = assembler.transform(work.filter(~F.col(missing[t])))
            fitted = model.fit(known.select("_x", F.col(t).cast("double").alias(t)))
            keep = VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="keep")
            scored = fitted.transform(keep.transform(work))
            work = scored.withColumn(t, F.when(F.col(missing[t]), F.col("_p")).otherwise(F.col(t))).drop("_x", "_p")
        if len(targets) > 1:
            # Every fit reads the frame several times; without this each round would run all earlier ones again.
            work = settle(work)
    return work.drop(*missing.values())
