"""Aggregate columns for forecast error."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.calendar import as_column
from tidemill.functions.scalars import abs_error, ape, squared_error

__all__ = [
    "met_mape", "met_mape_fraction", "met_mae", "met_medae", "met_me", "met_mse", "met_rmse",
    "met_r2",
]


def _paired(y: Column | str, p: Column | str) -> Column:
    return as_column(y).isNotNull() & as_column(p).isNotNull()


def met_mape(y: Column | str, p: Column | str) -> Column:
    """Mean absolute percentage error over non-zero actuals, in percent; null if none is left."""
    return F.avg(F.when(as_column(y) != 0, ape(y, p)))


def met_mape_fraction(y: Column | str, p: Column | str) -> Column:
    """As a fraction, with the denominator kept away from zero by machine epsilon."""
    floor = F.lit(sys.float_info.epsilon)
    return F.avg(abs_error(y, p) / F.greatest(F.abs(as_column(y)), floor))


def met_mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(abs_error(y, p))


def met_medae(y: Column | str, p: Column | str) -> Column:
    """Exact median; for groups of any size there is ``operators.evaluate.median_error``."""
    return F.median(abs_error(y, p))


def met_me(y: Column | str, p: Column | str) -> Column:
    return F.avg(as_column(y) - as_column(p))


def met_mse(y: Column | str, p: Column | str) -> Column:
    return F.avg(squared_error(y, p))


def met_rmse(y: Column | str, p: Column | str) -> Column:
    return F.sqrt(met_mse(y, p))


def met_r2(y: Column | str, p: Column | str) -> Column:
    """``1 - SSE/SST`` over complete pairs; SST as ``n * var_pop`` avoids a second pass."""
    sse = F.sum(squared_error(y, p))
    seen = F.when(_paired(y, p), as_column(y))
    return 1 - F.try_divide(sse, F.count(seen) * F.var_pop(seen))
