"""Exact quantiles of columns of any size.

`percentile` keeps a count per distinct value of a group in one task. That is right for small
groups; beyond a row bound the ranks are found by narrowing: a histogram of equal-width bins per
group (partial aggregation, bounded size), then only the bins that hold a wanted rank, and so on
until those bins are small enough to count value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.layout import join_null_safe
from tidemill.session import settle

BINS = 4096
MAX_ROUNDS = 24
FEW = 16


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    wide = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return wide.unpivot([F.col(f"`{c}`") for c in by], [F.col(f"`{c}`") for c in cols], "column_name", "_v").filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))


def _literal(probs: Sequence[float]) -> Column:
    """One literal, however many there are; an array of literals is walked by every rule of the optimiser."""
    return F.lit(np.asarray(probs, dtype=float))


def _ranks(probs: Sequence[float]) -> Column:
    """0-based ranks around ``p * (n - 1)``, both neighbours."""
    h = F.transform(_literal(probs), lambda p: p * (F.col("_n") - 1))
    return F.array_sort(F.array_distinct(F.concat(F.transform(h, lambda x: F.floor(x)),
                                                  F.transform(h, lambda x: F.ceil(x)))))


def _covered(ranks: Column, lo: Column, hi: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= lo) & (r < hi))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                    max_rows: int = 5_000_000) -> DataFrame:
    """Rows ``(by.., column_name, n, quantiles)``: linear between neighbouring ranks, nulls skipped."""
    long = _long(df, cols, by)
    g = [*by, "column_name"]
    stats = settle(long.groupBy(*g).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    largest = stats.agg(F.max("_n")).first()[0] or 0
    if largest <= max_rows:
        return _whole_groups(long, g, probs)
    small = F.col("_n") <= max_rows
    few = _whole_groups(join_null_safe(long, stats.filter(small).select(*g), g), g, probs)
    many = _narrow(long, stats.filter(~small), g, probs, max_rows)
    return few.unionByName(many)


def _whole_groups(long: DataFrame, g: list[str], probs: Sequence[float]) -> DataFrame:
    """Groups of a bounded size, one task each."""
    if len(probs) <= FEW:
        return long.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", _literal(probs)).alias("quantiles"))
    # Spark's percentile walks the values anew for every rank.
    keys, marks = list(g), np.asarray(probs, dtype=float)
    types = {f.name: f.dataType.simpleString() for f in long.schema.fields}

    def looked_up(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf["_v"].to_numpy(dtype=float))
        h = marks * (len(v) - 1)
        lo, hi = np.floor(h), np.ceil(h)
        low, high = v[lo.astype(int)], v[hi.astype(int)]
        at = np.where((lo == hi) | (low == high), low, (hi - h) * low + (h - lo) * high)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [len(v)], "quantiles": [at]})

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n long", "quantiles array<double>"])
    return long.groupBy(*g).applyInPandas(looked_up, schema)


def _narrow(long: DataFrame, stats: DataFrame, g: list[str], probs: Sequence[float], max_rows: int) -> DataFrame:
    # One open bin per group at first: the whole value range, with all wanted ranks.
    open_bins = stats.withColumns({"_ranks": _ranks(probs), "_base": F.lit(0).cast("long")})
    path: list[str] = []
    rows = join_null_safe(long, open_bins, g)
    for level in range(MAX_ROUNDS):
        # Halved differences keep the width finite for ranges near the double limits.
        place = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2) * BINS
        bin_col = f"_b{level}"
        binned = rows.withColumn(bin_col, F.coalesce(F.least(F.floor(place), F.lit(BINS - 1)), F.lit(0)).cast("int"))
        keys = [*g, *path, bin_col]
        hist = binned.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"),
            F.first("_base").alias("_base"), F.first("_ranks").alias("_ranks"), F.first("_n").alias("_n"))
        earlier = Window.partitionBy(*g, *path).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
        placed = hist.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        hit = placed.withColumn("_ranks", _covered(F.col("_ranks"), F.col("_base"), F.col("_base") + F.col("_c")))
        open_bins = settle(hit.filter(F.size("_ranks") > 0).select(
            *keys, F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"), "_base", "_ranks", "_n", "_c"))
        path.append(bin_col)
        rows = join_null_safe(binned.select(*keys, "_v"), open_bins.drop("_c"), keys)
        widest = open_bins.filter("_lo < _hi").agg(F.max("_c")).first()[0] or 0
        if widest <= max_rows:
            break
    values = rows.groupBy(*g, *path, "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.first("_base").alias("_base"), F.first("_ranks").alias("_ranks"),
        F.first("_n").alias("_n"))
    earlier = Window.partitionBy(*g, *path).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("_c").over(earlier), F.lit(0))
    ranked = values.withColumn("_start", start).select(
        *g, "_n", "_v", F.explode(_covered(F.col("_ranks"), F.col("_start"), F.col("_start") + F.col("_c"))).alias("_r"))
    looked = ranked.groupBy(*g).agg(
        F.max("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))
    marks = _literal(probs)

    def between(p: Column) -> Column:
        h = p * (F.col("n") - 1)
        low, high = F.col("_at")[F.floor(h)], F.col("_at")[F.ceil(h)]
        # as Spark's percentile has it, so groups of any size give the same digits
        return F.when((F.floor(h) == F.ceil(h)) | (low == high), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return looked.select(*g, "n", F.transform(marks, between).alias("quantiles"))


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict[str, list[float]]:
    """Quantiles of whole columns as a driver-side table: ``len(cols) * len(probs)`` numbers."""
    rows = exact_quantiles(df, cols, probs, **kw).select("column_name", "quantiles").collect()
    return {r[0]: list(r[1]) for r in rows}
