"""Calendar columns: month parsing, week keys in four conventions, epoch conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_column", "parse_month", "format_month", "iso_week", "iso_year", "monday_week", "week_key",
    "replace_year", "yearmonth_date", "yearmonth_parts", "calendar_features", "from_epoch_ms",
    "to_epoch_ms", "date_text_to_ms", "shift_time", "monday_on_or_after", "sunday_on_or_after",
]

# Month text layouts met in the inputs, and the matching Spark patterns.
MONTH_LAYOUTS = {
    "%Ym%m": "yyyy'M'MM",
    "%Y-%m": "yyyy-MM",
    "%Y%m": "yyyyMM",
    "%Y-%m-%d": "yyyy-MM-dd",
    "%Y/%m/%d": "yyyy/MM/dd",
}


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_month(col: Column | str, layout: str = "%Y-%m") -> Column:
    """Month or day text to a date; text that does not fit gives null."""
    return F.try_to_timestamp(F.upper(as_column(col)), F.lit(MONTH_LAYOUTS[layout])).cast("date")


def format_month(col: Column | str) -> Column:
    return F.date_format(as_column(col), "yyyy-MM")


def iso_week(col: Column | str) -> Column:
    return F.weekofyear(as_column(col))


def iso_year(col: Column | str) -> Column:
    return F.extract(F.lit("yearofweek"), as_column(col)).cast("int")


def monday_week(col: Column | str) -> Column:
    """Week of the year counted from the first Monday; days before it are week 0."""
    c = as_column(col)
    return F.floor((F.dayofyear(c) + F.lit(6) - F.weekday(c)) / F.lit(7)).cast("int")


def week_key(col: Column | str, convention: str = "iso_year", counter: Column | str | None = None) -> Column:
    """``year_week`` text.

    ``iso_year`` is the collision-free key. The other three reproduce how the separate inputs are
    keyed: ``calendar_iso`` (calendar year + ISO week, collides at year ends), ``monday``
    (calendar year + Monday week) and ``counter`` (calendar year + a given 1..52 counter).
    """
    c = as_column(col)
    if convention == "iso_year":
        year, week = iso_year(c), iso_week(c)
    elif convention == "calendar_iso":
        year, week = F.year(c), iso_week(c)
    elif convention == "monday":
        year, week = F.year(c), monday_week(c)
    elif convention == "counter":
        if counter is None:
            raise ValueError("convention 'counter' needs the counter column")
        year, week = F.year(c), as_column(counter)
    else:
        raise ValueError(f"unknown week convention: {convention}")
    return F.concat_ws("_", year.cast("string"), week.cast("string"))


def replace_year(col: Column | str, year: Column | int) -> Column:
    """Same month and day in another year; 29 February gives null in a common year."""
    c = as_column(col)
    y = F.lit(year) if isinstance(year, int) else year
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    lost = (F.month(c) == 2) & (F.dayofmonth(c) == 29) & ~leap
    day = F.when(lost, F.lit(28)).otherwise(F.dayofmonth(c))
    return F.when(~lost, F.make_date(y, F.month(c), day))


def yearmonth_parts(col: Column | str) -> tuple[Column, Column]:
    text = as_column(col).cast("string")
    return F.substring(text, 1, 4).cast("int"), F.substring(text, 5, 2).cast("int")


def yearmonth_date(col: Column | str, week: Column | str) -> Column:
    """First of the month in ``yyyymm`` moved on by ``week - 1`` weeks."""
    year, month = yearmonth_parts(col)
    return F.date_add(F.make_date(year, month, F.lit(1)), ((as_column(week) - 1) * 7).cast("int"))


def calendar_features(origin: Column | str, ahead_days: int = 1) -> dict[str, Column]:
    """Weekday (Monday 0), day of the year and ISO week of the day ``ahead_days`` after origin."""
    day = F.date_add(as_column(origin).cast("date"), ahead_days)
    return {
        "day_of_week": F.weekday(day),
        "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day),
    }


def from_epoch_ms(col: Column | str) -> Column:
    return F.timestamp_millis(as_column(col))


def to_epoch_ms(col: Column | str) -> Column:
    return F.unix_millis(as_column(col).cast("timestamp"))


def date_text_to_ms(col: Column | str, layout: str = "%Y/%m/%d") -> Column:
    return F.unix_millis(parse_month(col, layout).cast("timestamp"))


def shift_time(col: Column | str, hours: Column | int = 0, days: Column | int = 0) -> Column:
    def lit(x):
        return F.lit(x) if isinstance(x, int) else x

    return as_column(col) + F.make_dt_interval(lit(days), lit(hours))


def monday_on_or_after(col: Column | str) -> Column:
    c = as_column(col).cast("date")
    return F.date_add(c, F.pmod(F.lit(7) - F.weekday(c), F.lit(7)))


def sunday_on_or_after(col: Column | str) -> Column:
    c = as_column(col).cast("date")
    return F.date_add(c, F.lit(6) - F.weekday(c))
