"""Joins on week keys, calendars, horizons and as-of times."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.layout import LEN, POS, CutPoints, fill_forward, join_null_safe, number_rows, plan_cut


def join_week_inner(frames: Sequence[DataFrame], key: str | Sequence[str] = "year_week") -> DataFrame:
    """Inner equi-joins in the given order; keys need not be unique, matches fan out m:n."""
    return reduce(lambda a, b: a.join(b, key, "inner"), frames)


def join_calendar_left(cal: DataFrame, df: DataFrame, key: str | Sequence[str], fill: float | None = None) -> DataFrame:
    joined = cal.join(df, key, "left")
    return joined if fill is None else joined.fillna(fill)


def join_week_outer(a: DataFrame, b: DataFrame, key: str | Sequence[str] = "year_week") -> DataFrame:
    return a.join(b, key, "full")


def join_align(forecast: DataFrame, actual: DataFrame, keys: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Forecast rows with the actuals of the same time; columns neither side has become 0."""
    joined = join_null_safe(forecast, actual, keys, "left")
    missing = [c for c in columns if c not in joined.columns]
    return joined.withColumns({c: F.lit(0.0) for c in missing}) if missing else joined


def reindex_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns`` in order; those missing are filled with 0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def asof_positions(origins: DataFrame, readings: DataFrame, s: Sequence[str], o: str,
                   origin_col: str = "origin", max_rows: int | CutPoints | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered readings, and per origin the place of the last reading at or before it.

    Origins are merged into the readings and pick up the place of the row before them, which needs
    one ordered pass instead of a range join.
    """
    if isinstance(max_rows, int):
        max_rows = plan_cut(readings, s, o, max_rows)
    numbered = number_rows(readings, s, o, max_rows).drop(LEN)
    marks = numbered.select(*s, o, F.lit(0).alias("_mark"), F.col(POS).alias("_at"))
    asked = origins.select(*s, F.col(origin_col).cast(readings.schema[o].dataType).alias(o), F.lit(1).alias("_mark"),
                           F.lit(None).cast(marks.schema["_at"].dataType).alias("_at"))
    both = fill_forward(marks.unionByName(asked), s, [o, "_mark"], {"_at": F.col("_at")}, max_rows)
    found = both.filter("_mark = 1").select(*s, F.col(o).alias(origin_col), "_at")
    return numbered, found


def join_asof_last_n(origins: DataFrame, readings: DataFrame, s: Sequence[str], o: str, value: str,
                     n: int = 100, origin_col: str = "origin", max_rows: int | CutPoints | None = None) -> DataFrame:
    """For each origin, the last ``n`` non-null readings at or before it, newest first.

    Origins with fewer than ``n`` readings give no row. Each origin asks for ``n`` places, joined on
    ``(series, place)``: the keys are even whatever the length of a series.
    """
    known = readings.filter(F.col(value).isNotNull()).select(*s, o, value)
    numbered, found = asof_positions(origins, known, s, o, origin_col, max_rows)
    wanted = (found.filter(F.col("_at") >= n - 1)
              .withColumn(POS, F.explode(F.sequence(F.col("_at") - (n - 1), F.col("_at")))))
    cells = join_null_safe(wanted, numbered, [*s, POS])
    grouped = cells.groupBy(*s, origin_col).agg(
        F.max(o).alias("last_ts"),
        F.sort_array(F.collect_list(F.struct((-F.col(POS)).alias("k"), F.col(value).alias("v")))).alias("_cells"))
    return grouped.select(*s, origin_col, "last_ts", F.col("_cells.v").alias("history"))


def explode_predictions(pred: DataFrame, array_col: str = "predictions", horizon_col: str = "horizon",
                        value: str = "y_pred") -> DataFrame:
    """Array of predictions to one row a horizon, counted from 1."""
    keep = [c for c in pred.columns if c != array_col]
    return pred.select(*keep, F.posexplode(array_col).alias("_h", value)).select(
        *keep, (F.col("_h") + 1).alias(horizon_col), value)


def join_actual_pred(actual: DataFrame, pred: DataFrame, s: Sequence[str], horizon_col: str = "horizon") -> DataFrame:
    """Pair by horizon; the shorter side sets the length."""
    return pred.join(actual, [*s, horizon_col], "inner")
