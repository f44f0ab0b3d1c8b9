"""Row-level feature columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.calendar import as_column

__all__ = [
    "ratio", "seasonal_cos", "strip_suffix", "sentinel_null", "number_or_null", "coalesce_zero",
    "nan_to_null", "ape", "abs_error", "squared_error", "pct_change",
]


def ratio(num: Column | str, den: Column | str) -> Column:
    """Quotient; a zero denominator gives null instead of failing the job."""
    return F.try_divide(as_column(num), as_column(den))


def seasonal_cos(week: Column | str, period: int = 52) -> Column:
    return F.cos(as_column(week) * F.lit(2 * math.pi / period))


def strip_suffix(col: Column | str, suffix: str) -> Column:
    return F.regexp_replace(as_column(col), f"\\Q{suffix}\\E$", "")


def sentinel_null(col: Column | str, sentinel: str = "c") -> Column:
    return F.nullif(F.trim(as_column(col)), F.lit(sentinel))


def number_or_null(col: Column | str, sentinel: str = "c") -> Column:
    """Text cell to double: the missing mark, unreadable text and NaN give null."""
    return nan_to_null(sentinel_null(col, sentinel).try_cast("double"))


def coalesce_zero(col: Column | str) -> Column:
    return F.coalesce(as_column(col), F.lit(0.0))


def nan_to_null(col: Column | str) -> Column:
    c = as_column(col)
    return F.when(~F.isnan(c), c)


def ape(actual: Column | str, predicted: Column | str) -> Column:
    """Absolute percentage error; null for a zero actual."""
    a, p = as_column(actual), as_column(predicted)
    return F.abs(F.try_divide(a - p, a)) * 100


def abs_error(actual: Column | str, predicted: Column | str) -> Column:
    return F.abs(as_column(actual) - as_column(predicted))


def squared_error(actual: Column | str, predicted: Column | str) -> Column:
    diff = as_column(actual) - as_column(predicted)
    return diff * diff


def pct_change(now: Column | str, before: Column | str) -> Column:
    return F.try_divide(as_column(now), as_column(before)) - 1
