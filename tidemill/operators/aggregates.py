"""Week means, row means, resampling, price summaries, correlation and Gram blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.calendar import sunday_on_or_after
from tidemill.operators.clean import suffix_columns
from tidemill.operators.layout import complete_rows, join_null_safe, names
from tidemill.operators.reshape import series_grid
from tidemill.operators.timeseries import win_pct_change

# Rows that give a middling value of each column.
ORIGIN_ROWS = 1_000


def agg_week_mean(df: DataFrame, key: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*names(key)).agg(*[F.avg(f"`{c}`").alias(c) for c in cols])


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over columns of one row, nulls skipped."""
    cells = [F.col(f"`{c}`") for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cells])
    count = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cells])
    return F.try_divide(total, count)


def agg_row_mean(df: DataFrame, suffix: str, out: str) -> DataFrame:
    return df.withColumn(out, row_mean(suffix_columns(df, [suffix])))


def agg_resample_mean(df: DataFrame, s: Sequence[str], o: str, cols: Sequence[str]) -> DataFrame:
    """Weeks ending on Sunday: mean per week, empty weeks take the mean of all rows of the series."""
    cols = names(cols)
    week = df.withColumn("_week", sunday_on_or_after(o))
    means = week.groupBy(*s, "_week").agg(*[F.avg(c).alias(c) for c in cols]).withColumnRenamed("_week", o)
    overall = df.groupBy(*s).agg(*[F.avg(c).alias(f"_all_{c}") for c in cols])
    grid = series_grid(means, s, o, "W-SUN")
    joined = join_null_safe(join_null_safe(grid, means, [*s, o], "left"), overall, s, "left")
    return joined.select(*s, o, *[F.coalesce(c, f"_all_{c}").alias(c) for c in cols])


def agg_minmax_time(df: DataFrame, s: Sequence[str], o: str) -> DataFrame:
    return df.groupBy(*s).agg(F.min(o).alias("first_ts"), F.max(o).alias("last_ts"))


def pct_change_mean(change: str = "_chg") -> Column:
    return F.avg(change) * 100


def total_change(change: str = "_chg") -> Column:
    return F.product(1 + F.coalesce(F.col(change), F.lit(0.0))) * 100 - 100


def agg_price_summary(df: DataFrame, s: Sequence[str], o: str, col: str) -> DataFrame:
    """Average change, compounded change, mean and median per series, by falling average change."""
    changed = win_pct_change(df, s, o, col, "_chg")
    return changed.groupBy(*s).agg(
        pct_change_mean().alias("avg_change"),
        total_change().alias("total_change"),
        F.avg(col).alias("mean_price"),
        F.median(col).alias("median_price"),
    ).orderBy(F.col("avg_change").desc_nulls_last(), *s)


def pair_sums(df: DataFrame, cols: Sequence[str], block_col: str | None = None, origin: Sequence[float] | None = None) -> DataFrame:
    """Per block and pair of columns ``i <= j``, over the rows that know both: rows
    ``(block, i, j, n, sum_i, sum_j, sq_i, sq_j, prod)`` of values less their column's ``origin``.

    A task hands on its matrix products, a row a pair and block, whatever the number of its rows. NaN is a gap.
    """
    d, zero = len(cols), np.zeros(len(cols)) if origin is None else np.asarray(origin, dtype=float)
    block = F.lit(0) if block_col is None else F.col(block_col)
    cast = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)]
    rows = df.select(block.alias("block"), *cast)
    upper = np.triu_indices(d)
    sums = ["n", "sum_i", "sum_j", "sq_i", "sq_j", "prod"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for pdf in batches:
            values = pdf.iloc[:, 1:].to_numpy(dtype=float) - zero
            codes, labels = pd.factorize(pdf["block"], use_na_sentinel=False)
            for code, label in enumerate(labels):
                part = values[codes == code]
                known = ~np.isnan(part)
                v, m = np.where(known, part, 0.0), known.astype(float)
                s, q = v.T @ m, (v * v).T @ m
                new = np.stack([m.T @ m, s, s.T, q, q.T, v.T @ v])
                key = None if pd.isna(label) else label
                found[key] = found[key] + new if key in found else new
        for label, total in found.items():
            yield pd.DataFrame({"block": [label] * len(upper[0]), "i": upper[0], "j": upper[1],
                                **{c: t[upper] for c, t in zip(sums, total)}})

    kind = rows.schema["block"].dataType.simpleString()
    parts = rows.mapInPandas(partial, f"block {kind}, i int, j int, " + ", ".join(f"{c} double" for c in sums))
    return parts.groupBy("block", "i", "j").agg(*[F.sum(c).alias(c) for c in sums])


def agg_corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows ``(feature_a, feature_b, corr)`` for all ordered pairs, each over the rows that know both; one pass.

    A pair without spread has none. Values are taken from a middling one of a few rows, which keeps the accuracy.
    """
    cols, d = list(cols), len(cols)
    middle = df.limit(ORIGIN_ROWS).agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), 0.5) for c in cols]).first()
    cells = pair_sums(df, cols, origin=[v or 0.0 for v in middle])
    n = F.col("n")
    cov, var_i, var_j = (F.col(p) - F.try_divide(F.col(a) * F.col(b), n) for p, a, b in (
        ("prod", "sum_i", "sum_j"), ("sq_i", "sum_i", "sum_i"), ("sq_j", "sum_j", "sum_j")))
    known = cells.select("i", "j", F.try_divide(cov, F.sqrt(F.greatest(var_i, F.lit(0.0))) * F.sqrt(F.greatest(var_j, F.lit(0.0)))).alias("corr"))
    place = F.col("id").cast("int")
    grid = df.sparkSession.range(d * d).select(F.floor(place / d).cast("int").alias("a"), (place % d).alias("b"))
    named = F.array(*[F.lit(c) for c in cols])
    both = grid.withColumns({"i": F.least("a", "b"), "j": F.greatest("a", "b")}).join(known, ["i", "j"], "left")
    return both.select(F.get(named, F.col("a")).alias("feature_a"), F.get(named, F.col("b")).alias("feature_b"),
                       F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("corr")).alias("corr"))


def agg_gram(df: DataFrame, features: Sequence[str], y: str, block_col: str) -> DataFrame:
    """Per block: sums of products of all pairs of features, target and the constant.

    Rows ``(block, a, b, v)`` with ``a <= b`` in the given order, the constant named ``1``. Every
    linear fit on any union of blocks follows from these sums, so one pass serves all folds. Rows
    without a target are left out; a product with a gap adds nothing.
    """
    terms = ["1", *features, y]
    rows = complete_rows(df, [y]).withColumn("_one", F.lit(1.0))
    named = F.array(*[F.lit(c) for c in terms])
    cells = pair_sums(rows, ["_one", *features, y], block_col)
    return cells.select(F.col("block").alias(block_col), F.get(named, F.col("i")).alias("a"), F.get(named, F.col("j")).alias("b"), F.col("prod").alias("v"))


def agg_distinct_series(df: DataFrame, s: Sequence[str]) -> DataFrame:
    return df.select(*s).distinct()
