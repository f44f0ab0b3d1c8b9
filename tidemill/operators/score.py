"""Feature scores and the choice of the best k features."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.ml.histograms import Bins, joint_counts, mutual_information
from tidemill.ml.trees import bin_rows, importances
from tidemill.operators.split import topk_features

Scorer = Callable[[DataFrame, Sequence[str], str], DataFrame]


def _correlations(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """``(feature, r, n)`` of the rows with a target, unknown features taken for their mean; one aggregation.

    With the mean filled in, a gap adds nothing to the products and the feature's squares, so sums over known values
    are enough. This is what `tidemill.ml.gram.correlations` has from its sums.
    """
    target = F.nanvl(F.col(f"`{y}`").cast("double"), F.lit(None).cast("double"))
    xs = [F.when(target.isNotNull(), F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double"))) for f in features]
    one = df.agg(F.count(target).alias("n"), F.var_pop(target).alias("vy"), *[a for i, x in enumerate(xs) for a in (
        F.count(x).alias(f"n{i}"), F.var_pop(x).alias(f"v{i}"), F.covar_pop(x, target).alias(f"c{i}"))])
    rs = [F.sqrt(F.col(f"n{i}") / F.col("n")) * F.try_divide(F.col(f"c{i}"), F.sqrt(F.col(f"v{i}")) * F.sqrt("vy")) for i in range(len(features))]
    cells = [F.struct(F.lit(f).alias("feature"), r.alias("r"), F.col("n").alias("n")) for f, r in zip(features, rs)]
    return one.select(F.inline(F.array(*cells)))


def score_f(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """F statistic of a one-feature fit; a constant feature scores 0."""
    r2 = F.col("r") * F.col("r")
    f = F.when(F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(
        F.when(r2 >= 1, F.lit(math.inf)).otherwise(F.try_divide(r2, 1 - r2)) * (F.col("n") - 2))
    return _correlations(df, features, y).select("feature", f.alias("score"))


def score_pearson(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    r = F.when(~F.isnan("r"), F.abs("r"))
    return _correlations(df, features, y).select("feature", r.alias("score"))


def score_mi(df: DataFrame, features: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """Mutual information of equal-width bins, in nats, over the rows that know the feature."""
    cols = [*features, y]
    xs = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols]
    known = df.where(xs[-1].isNotNull())
    ends = known.agg(*[f(x) for x in xs for f in (F.min, F.max)]).first()
    widths = [Bins(float(ends[2 * i] or 0.0), float(ends[2 * i + 1] or 0.0), count=bins) for i in range(len(cols))]
    counts = joint_counts(known, features, y, [widths[:-1]], widths[-1])
    found = mutual_information(counts[0][0]) if counts else [0.0] * len(features)
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, found)], "feature string, score double")


def score_importance(df: DataFrame, features: Sequence[str], y: str, seed: int = 42, **forest) -> DataFrame:
    """Random forest importance; one number a feature comes back to the driver. Gaps take the feature's mean."""
    found = importances(bin_rows(df, features, y), [None], seed, **forest)[None]
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, found)], "feature string, score double")


# Scorer names and how many features each keeps.
SCORERS: dict[str, Scorer | None] = {
    "F_regression": score_f,
    "Mutual_info_regression": score_mi,
    "Pearson Correlation": score_pearson,
    "Feature Importance": score_importance,
    "No scoring": None,
}
K_VALUES = {
    "F_regression": 15,
    "Mutual_info_regression": 25,
    "Pearson Correlation": 35,
    "Feature Importance": 5,
}
DEFAULT_K = 5


def select_kbest(df: DataFrame, features: Sequence[str], y: str, scorer: str | Scorer | None = "F_regression",
                 k: int | None = None, keys: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Frame with keys, target and the best ``k`` features, and their names in column order."""
    fn = SCORERS[scorer] if isinstance(scorer, str) else scorer
    if fn is None:
        return df, []
    k = k or (K_VALUES.get(scorer, DEFAULT_K) if isinstance(scorer, str) else DEFAULT_K)
    best = {r[0] for r in topk_features(fn(df, features, y), k).select("feature").collect()}
    chosen = [f for f in features if f in best]
    return df.select(*keys, y, *[F.col(f"`{f}`") for f in chosen]), chosen
