"""Wide and long forms, repeated rows, calendars and regular grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.calendar import monday_on_or_after, sunday_on_or_after
from tidemill.operators.layout import fill_forward, join_null_safe, series_window


def reshape_unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name",
                    value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def reshape_pivot(df: DataFrame, ids: Sequence[str], name: str, values: Sequence[str], agg: Column) -> DataFrame:
    """Long to wide. The value list is given, so no extra job looks for it."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(agg)


def reshape_repeat_rows(df: DataFrame, n: Column, index: str | None = None) -> DataFrame:
    """Repeat each row ``n`` times; rows with ``n < 1`` go. ``index`` numbers the copies from 1."""
    copies = F.explode(F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))))
    out = df.withColumn(index or "_copy", copies)
    return out if index else out.drop("_copy")


def month_to_weeks(df: DataFrame, s: Sequence[str], o: str, start_week: int = 5) -> DataFrame:
    """Monthly rows to 13 weeks a quarter (5, 4, 4) with a week counter that wraps at 52.

    Row ``i`` of a series starts after ``13*(i div 3) + (0, 5, 9)[i mod 3]`` weeks, so the counter
    needs the month's place only, not a second window over the repeated rows.
    """
    i = F.row_number().over(series_window(s, o)) - 1
    placed = df.withColumn("_i", i)
    third = F.pmod(F.col("_i"), F.lit(3))
    done = F.floor(F.col("_i") / 3) * 13 + F.when(third == 0, 0).when(third == 1, 5).otherwise(9)
    weeks = reshape_repeat_rows(placed.withColumn("_done", done), F.when(third == 0, 5).otherwise(4), "_k")
    counter = F.pmod(F.col("_done") + F.col("_k") - 1 + (start_week - 1), F.lit(52)) + 1
    return weeks.withColumn("week", counter.cast("int")).drop("_i", "_done", "_k")


# Grid step names and the first grid point at or after a date.
GRID_START = {"W-MON": monday_on_or_after, "W-SUN": sunday_on_or_after}
STEPS = {"W-MON": "7 days", "W-SUN": "7 days", "D": "1 day", "h": "1 hour"}


def reshape_calendar(spark: SparkSession, start: str, end: str, step: str = "W-MON", name: str = "ts") -> DataFrame:
    """Regular grid between two bounds, both kept when they fall on it."""
    one = spark.range(1)
    if step == "h":
        lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    else:
        lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
        if step in GRID_START:
            lo = GRID_START[step](lo)
    grid = F.when(lo <= hi, F.sequence(lo, hi, F.expr(f"interval {STEPS[step]}")))
    return one.select(F.explode(grid).alias(name))


def series_grid(df: DataFrame, s: Sequence[str], o: str, step: str, end_after: bool = False) -> DataFrame:
    """Per series, the grid from its first to its last time (``end_after``: last grid point covers it)."""
    ends = df.groupBy(*s).agg(F.min(o).alias("_lo"), F.max(o).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    if step in GRID_START:
        lo = GRID_START[step](lo)
        hi = GRID_START[step](hi) if end_after else hi.cast("date")
    grid = F.when(lo <= hi, F.sequence(lo, hi, F.expr(f"interval {STEPS[step]}")))
    return ends.select(*s, F.explode(grid).alias(o))


def reshape_asfreq(df: DataFrame, s: Sequence[str], o: str, step: str = "W-SUN",
                   cols: Sequence[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Series on a grid, each point holding the last row at or before it.

    Grid points are merged into the series and take the row before them in one ordered pass, so no
    range join is needed.
    """
    cols = list(cols or [c for c in df.columns if c not in (*s, o)])
    grid = series_grid(df, s, o, step)
    rows = df.select(*s, F.col(o).cast(grid.schema[o].dataType).alias(o), F.lit(0).alias("_grid"),
                     F.struct(*cols).alias("_row"))
    points = grid.withColumn("_grid", F.lit(1)).withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    both = rows.unionByName(points)
    filled = fill_forward(both, s, [o, "_grid"], {"_row": F.col("_row")}, max_rows)
    return filled.filter("_grid = 1").select(*s, o, *[F.col(f"_row.`{c}`").alias(c) for c in cols])


def set_union_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Gather result records; columns one side lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
