"""Scalers: parameters from one frame, applied as column expressions to any other.

A fitted scaler is a small table of numbers per column, so applying it adds no job and no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.quantiles import quantile_values


@dataclass(frozen=True)
class ScalerParams:
    """``(x - shift) / scale`` per column, or quantile tables for the quantile scaler."""

    kind: str
    affine: dict[str, tuple[float, float]] = field(default_factory=dict)
    tables: dict[str, list[float]] = field(default_factory=dict)


def _stats(df: DataFrame, cols: Sequence[str], *aggs) -> list[tuple]:
    row = df.agg(*[a(F.col(f"`{c}`").cast("double")) for c in cols for a in aggs]).first()
    width = len(aggs)
    return [tuple(row[i * width:(i + 1) * width]) for i in range(len(cols))]


def _nonzero(x: float | None) -> float:
    return 1.0 if x is None or x == 0 else float(x)


# Affine scalers that users add: ``fit(df, cols)`` gives ``{column: (shift, scale)}``.
USER_KINDS: dict[str, Callable[[DataFrame, Sequence[str]], dict[str, tuple[float, float]]]] = {}
BUILT_IN = ("minmax", "standard", "robust", "quantile", "none")


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str, n_quantiles: int = 1000,
               max_rows: int = 5_000_000) -> ScalerParams:
    cols = list(cols)
    if kind in USER_KINDS:
        got = USER_KINDS[kind](df, cols)
        return ScalerParams(kind, {c: (float(got[c][0] or 0.0), _nonzero(got[c][1])) for c in cols})
    if kind == "none":
        return ScalerParams(kind, {c: (0.0, 1.0) for c in cols})
    if kind == "minmax":
        got = _stats(df, cols, F.min, F.max)
        return ScalerParams(kind, {c: (float(lo or 0.0), _nonzero(None if lo is None else hi - lo))
                                   for c, (lo, hi) in zip(cols, got)})
    if kind == "standard":
        got = _stats(df, cols, F.avg, F.stddev_pop)
        return ScalerParams(kind, {c: (float(m or 0.0), _nonzero(sd)) for c, (m, sd) in zip(cols, got)})
    if kind == "robust":
        table = quantile_values(df, cols, [0.25, 0.5, 0.75], max_rows=max_rows)
        return ScalerParams(kind, {c: robust_affine(table.get(c)) for c in cols})
    if kind == "quantile":
        n = max(2, min(n_quantiles, df.count()))
        return ScalerParams(kind, tables=quantile_values(df, cols, list(np.linspace(0, 1, n)), max_rows=max_rows))
    raise KeyError(f"unknown scaler: {kind}")


def robust_affine(quartiles: Sequence[float] | None) -> tuple[float, float]:
    low, middle, high = quartiles or (0.0, 0.0, 0.0)
    return middle, _nonzero(high - low)


def uniform_place(table: Sequence[float], v: np.ndarray) -> np.ndarray:
    """Place in the quantile table, ties averaged from both sides; unknown stays unknown."""
    q, ref = np.asarray(table), np.linspace(0, 1, len(table))
    up = np.interp(v, q, ref)
    down = -np.interp(-v, -q[::-1], -ref[::-1])
    out = 0.5 * (up + down)
    out[v <= q[0]] = 0.0
    out[v >= q[-1]] = 1.0
    out[np.isnan(v)] = np.nan
    return out


def _uniform(table: list[float]):
    """Arrow batches, no per-row Python."""
    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(uniform_place(table, x.to_numpy(dtype=float)))

    return place


def scaled(params: ScalerParams, col: str) -> Column:
    x = F.col(f"`{col}`").cast("double")
    if params.kind == "quantile":
        return F.when(x.isNotNull(), _uniform(params.tables[col])(x)) if col in params.tables else x
    shift, scale = params.affine[col]
    return x if params.kind == "none" else (x - F.lit(shift)) / F.lit(scale)


def apply_scaler(df: DataFrame, cols: Sequence[str], params: ScalerParams) -> DataFrame:
    new = {c: scaled(params, c).alias(c) for c in cols}
    return df.select(*[new.get(c, F.col(f"`{c}`")) for c in df.columns])


def _scale(kind: str):
    def scale(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None, **kw) -> tuple[DataFrame, ScalerParams]:
        params = fit_scaler(fit_df if fit_df is not None else df, cols, kind, **kw)
        return apply_scaler(df, cols, params), params

    scale.__name__ = f"scale_{kind}"
    return scale


scale_minmax = _scale("minmax")
scale_standard = _scale("standard")
scale_robust = _scale("robust")
scale_quantile = _scale("quantile")
scale_none = _scale("none")


def scale_inverse(df: DataFrame, cols: Sequence[str], params: ScalerParams, source: str | None = None) -> DataFrame:
    """Undo an affine scaler. ``source`` names the fitted column whose numbers apply to all ``cols``."""
    if params.kind == "quantile":
        raise ValueError("only affine scalers are undone")
    new = {}
    for c in cols:
        shift, scale = params.affine[source or c]
        new[c] = F.col(f"`{c}`") * F.lit(scale) + F.lit(shift)
    return df.withColumns(new)
