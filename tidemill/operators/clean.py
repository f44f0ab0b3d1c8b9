"""Column choice, row filters, de-duplication and input checks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.calendar import as_column
from tidemill.operators.layout import complete_rows, names


def suffix_columns(df: DataFrame, suffixes: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c.endswith(tuple(suffixes))]


def proj_suffix(df: DataFrame, suffixes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *[c for c in suffix_columns(df, names(suffixes)) if c not in keys])


def proj_regex(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*[c for c in df.columns if re.search(pattern, c)])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def proj_numeric(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *[c for c in numeric_columns(df) if c not in keys])


def proj_drop(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    """Drop by name; names that are not there are ignored."""
    return df.drop(*drop)


def proj_keep(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in keep if c in df.columns])


def proj_reorder(df: DataFrame, front: Sequence[str]) -> DataFrame:
    return df.select(*front, *[c for c in df.columns if c not in front])


def proj_rename(df: DataFrame, prefix: str = "", suffix: str = "", keys: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in df.columns if c not in keys})


def proj_dedup_cols(df: DataFrame) -> DataFrame:
    """Keep the first of equally named columns."""
    if len(set(df.columns)) == len(df.columns):
        return df
    marked = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    firsts = {}
    for i, c in enumerate(df.columns):
        firsts.setdefault(c, i)
    return marked.select(*[F.col(f"_{i}").alias(c) for c, i in firsts.items()])


def filter_date_range(df: DataFrame, col: str, lo: date | str, hi: date | str) -> DataFrame:
    """Closed range; the bounds become literals of the column's own type, so the scan can skip."""
    kind = df.schema[col].dataType.simpleString()
    return df.filter(F.col(col).between(F.lit(str(lo)).cast(kind), F.lit(str(hi)).cast(kind)))


def filter_month_string(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Compare text with text: month ``2009-01`` is before ``2009-01-01`` and falls out."""
    return df.filter(F.col(col).between(lo, hi))


def filter_dropna(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return complete_rows(df, cols)


def column_flags(df: DataFrame, cols: Sequence[str], test) -> dict[str, bool]:
    """One pass, one row: whether ``test(column)`` holds anywhere in each column."""
    row = df.agg(*[F.max(test(F.col(f"`{c}`"))).alias(f"f{i}") for i, c in enumerate(cols)]).first()
    return {c: bool(row[i]) for i, c in enumerate(cols)}


def filter_allzero_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns holding nothing but zeros; a null keeps the column."""
    keep = column_flags(df, cols, lambda c: F.coalesce(c != 0, F.lit(True)))
    return df.drop(*[c for c in cols if not keep[c]])


def allzero_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same test as rows ``(column_name, all_zero)``; lazy."""
    flags = df.agg(*[F.max(F.coalesce(F.col(f"`{c}`") != 0, F.lit(True))).alias(c) for c in cols])
    long = flags.unpivot([], list(cols), "column_name", "_any")
    return long.select("column_name", (~F.coalesce("_any", F.lit(False))).alias("all_zero"))


def null_columns_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "null_count")


def filter_not_null_asof(df: DataFrame, col: str, time_col: str, asof: Column | str) -> DataFrame:
    bound = F.lit(asof).cast(df.schema[time_col].dataType) if isinstance(asof, str) else asof
    return df.filter(F.col(col).isNotNull() & (F.col(time_col) <= bound))


def dedup_time(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """First row per key in source order; partial aggregation keeps a hot key off one task."""
    keys = names(key)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*names(order))).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def check_columns(df: DataFrame, required: Sequence[str], target: str | None = None) -> DataFrame:
    """Fail before any job runs when a needed column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        listed = " or ".join(f"'{c}'" for c in required)
        raise KeyError(f"Required columns {listed} are missing from the DataFrame: {missing}")
    if target is not None and target not in df.columns:
        raise KeyError(f"target column '{target}' is missing")
    return df


def wide_clean(df: DataFrame, key: str, drop: Sequence[str] = (), sentinel: str = "c",
               key_pattern: str | None = None) -> DataFrame:
    """Raw wide text sheet to numbers: unnamed columns, footers and missing marks go.

    Header and footer lines are told by ``key_pattern`` on the key rather than by row position,
    which a distributed read does not keep.
    """
    from tidemill.functions.scalars import number_or_null

    keep = [c for c in df.columns if c != key and "Unnamed" not in c and c not in drop]
    if key_pattern:
        df = df.filter(as_column(key).rlike(key_pattern))
    return df.select(key, *[number_or_null(f"`{c}`", sentinel).alias(c) for c in keep])
