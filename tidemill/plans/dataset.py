"""The weekly dataset: five sources cleaned, brought to weekly grain and joined on ``year_week``.

Every stage is lazy; only the final table is worth storing. Column lists are keep lists by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.calendar import iso_week, monday_week, parse_month, replace_year, week_key, yearmonth_parts
from tidemill.operators.aggregates import agg_row_mean, agg_week_mean
from tidemill.operators.clean import filter_allzero_cols, filter_date_range, filter_month_string, proj_rename, suffix_columns, wide_clean
from tidemill.operators.impute import imp_model, imp_seasonal
from tidemill.operators.joins import join_calendar_left, join_week_inner, join_week_outer
from tidemill.operators.reshape import month_to_weeks, reshape_calendar
from tidemill.operators.timeseries import win_interpolate

KINDS = ("rain", "soil", "sun")


def price_stage(sheet: DataFrame, month_col: str, lo: str, hi: str, drop: Sequence[str] = (), start_week: int = 5,
                suffix: str = "_Milk_Price") -> DataFrame:
    """Monthly text sheet to 52 weeks a year, one price column a country.

    The month range compares text, so a lower bound with a day excludes its own month. The sheet is
    one row a month, so a single window over it is bounded by the calendar.
    """
    clean = wide_clean(sheet, month_col, drop, key_pattern=r"^\d{4}M\d{2}$")
    dated = clean.withColumn("Date", parse_month(month_col, "%Ym%m")).withColumn("month", F.date_format("Date", "yyyy-MM"))
    ranged = filter_month_string(dated.drop(month_col) if month_col != "month" else dated, "month", lo, hi).drop("month")
    priced = proj_rename(ranged, suffix=suffix, keys=["Date"])
    weeks = month_to_weeks(priced.withColumn("_one", F.lit(1)), ["_one"], "Date", start_week).drop("_one")
    return weeks.withColumn("year_week", week_key("Date", "counter", "week")).drop("Date", "week")


def grass_stage(sheet: DataFrame, years: Sequence[int], lo: str, hi: str, impute: str = "seasonal") -> DataFrame:
    """Day-of-year rows x year columns to ``(Date, year_week, Week, Grass_growth)``.

    The weekly calendar meets the readings by an outer join on the Monday week key, which fans weeks
    out to their daily readings; weeks without readings are filled.
    """
    long = sheet.unpivot(["Date"], [str(y) for y in years], "year", "Grass_growth")
    moved = long.select(replace_year("Date", F.col("year").cast("int")).alias("day"), "Grass_growth").filter("day IS NOT NULL")
    readings = moved.select(week_key("day", "monday").alias("year_week"), "Grass_growth")
    cal = reshape_calendar(sheet.sparkSession, lo, hi, "W-MON", "Date").select(
        "Date", monday_week("Date").alias("Week"), week_key("Date", "monday").alias("year_week"))
    merged = join_week_outer(cal, readings, "year_week")
    # Keys of one side only have no calendar week; the number is in the key itself.
    merged = merged.withColumn("Week", F.coalesce("Week", F.split_part("year_week", F.lit("_"), F.lit(2)).cast("int")))
    if impute == "seasonal":
        return imp_seasonal(merged, "Grass_growth", "Week")
    return imp_model(merged, "Grass_growth", ["Week"])


def yield_stage(raw: DataFrame, keep: Sequence[str] = ("litres", "num_suppliers")) -> DataFrame:
    year, _ = yearmonth_parts("year_month")
    return raw.select(F.concat_ws("_", year.cast("string"), F.col("week").cast("string")).alias("year_week"), *keep)


def inflation_stage(monthly: DataFrame, cols: dict[str, str], lo: str, hi: str, anchors: str = "grid") -> DataFrame:
    """Monthly rates to Mondays. Interpolation comes before the date range, as anchors lie outside it."""
    weekly = win_interpolate(monthly.withColumn("_one", F.lit(1)), ["_one"], "Date", list(cols), "W-MON", anchors)
    ranged = filter_date_range(weekly, "Date", lo, hi)
    return ranged.select(week_key("Date", "calendar_iso").alias("year_week"), *[F.col(c).alias(n) for c, n in cols.items()])


def weather_stage(daily: DataFrame, lo: str, hi: str) -> DataFrame:
    """Daily station columns to weekly means of row means on the full calendar, empty weeks 0."""
    stations = suffix_columns(daily, [f"_{k}" for k in KINDS])
    ranged = filter_date_range(daily.select("Date", *stations), "Date", lo, hi)
    kept = filter_allzero_cols(ranged, stations)
    for kind in KINDS:
        kept = agg_row_mean(kept, f"_{kind}", f"mean_{kind}")
    means = [f"mean_{k}" for k in KINDS]
    weekly = agg_week_mean(kept.withColumn("year_week", week_key("Date", "calendar_iso")), "year_week", means)
    cal = reshape_calendar(daily.sparkSession, lo, hi, "W-MON", "Date").select(
        F.concat_ws("_", F.year("Date").cast("string"), iso_week("Date").cast("string")).alias("year_week"))
    return join_calendar_left(cal, weekly, "year_week", fill=0.0)


def final_stage(prices: DataFrame, grass: DataFrame, yields: DataFrame, weather: DataFrame, inflation: DataFrame,
                keep: Sequence[str] | None = None) -> DataFrame:
    """Four inner joins on ``year_week``; ``keep`` lists the columns of the published table."""
    df = join_week_inner([prices, grass, yields, weather, inflation], "year_week")
    front = ["Date", "year_week"]
    rest = [c for c in (keep if keep is not None else df.columns) if c not in front]
    return df.select(*front, *[f"`{c}`" for c in rest])
