"""Lags, leads, smoothers, filling, interpolation, autocorrelation and seasonal split."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalars import pct_change
from tidemill.operators.layout import (
    BLOCK,
    LEN,
    POS,
    CutPoints,
    _add,
    complete_rows,
    fill,
    fill_backward,
    fill_forward,
    join_null_safe,
    names,
    number_rows,
    plan_cut,
    running,
    with_neighbours,
)
from tidemill.operators.reshape import GRID_START, STEPS, series_grid


def _total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _planned(df: DataFrame, s: Sequence[str], o: str | Sequence[str], max_rows: int | CutPoints | None):
    """Cut once for operators that take several passes over the same series."""
    return plan_cut(df, s, o, max_rows) if isinstance(max_rows, int) else max_rows


def shift(col: str | Column, by: int, near) -> Column:
    """Value ``by`` rows on (negative: back)."""
    return F.lead(col, by).over(near.window) if by > 0 else F.lag(col, -by).over(near.window) if by < 0 else (
        F.col(col) if isinstance(col, str) else col)


def win_lag_features(df: DataFrame, s: Sequence[str], o: str, cols: Sequence[str], lag: int,
                     dropna: bool = True, max_rows: int | CutPoints | None = None) -> DataFrame:
    """Columns ``{c}-1 .. {c}-lag``; ``dropna`` drops every row that holds a null."""
    cols = names(cols)
    out = with_neighbours(df, s, o, lag, 0, lambda near: {
        f"{c}-{i}": F.lag(c, i).over(near.window) for c in cols for i in range(1, lag + 1)}, max_rows)
    return complete_rows(out) if dropna else out


def win_multistep(df: DataFrame, s: Sequence[str], o: str, target: str, n_steps: int,
                  dropna: bool = True, max_rows: int | CutPoints | None = None) -> DataFrame:
    out = with_neighbours(df, s, o, 0, n_steps, lambda near: {
        f"{target}_step_{i}": F.lead(target, i).over(near.window) for i in range(1, n_steps + 1)}, max_rows)
    return complete_rows(out) if dropna else out


def win_expanding_mean(df: DataFrame, s: Sequence[str], o: str, col: str, include_current: bool = True,
                       out: str = "past_values", max_rows: int | CutPoints | None = None) -> DataFrame:
    """Running mean. ``include_current=False`` is the form that does not leak the current value."""
    sums = {"_sum": F.col(col).cast("double"), "_cnt": F.when(F.col(col).isNotNull(), 1).otherwise(0)}
    summed = running(df, s, o, sums, max_rows)
    total, count = F.col("_sum"), F.col("_cnt")
    if not include_current:
        total = total - F.coalesce(F.col(col), F.lit(0.0))
        count = count - F.when(F.col(col).isNotNull(), 1).otherwise(0)
    mean = F.when(count > 0, total / F.when(count > 0, count))
    return summed.withColumn(out, mean).drop("_sum", "_cnt")


def win_ma(df: DataFrame, s: Sequence[str], o: str, cols: Sequence[str], w: int, suffix: str = "_MA",
           max_rows: int | CutPoints | None = None) -> DataFrame:
    """Moving average over up to ``w`` rows, from the first row on."""
    return with_neighbours(df, s, o, w - 1, 0, lambda near: {
        f"{c}{suffix}": F.avg(c).over(near.window.rowsBetween(-(w - 1), 0)) for c in names(cols)}, max_rows)


def win_wma(df: DataFrame, s: Sequence[str], o: str, cols: Sequence[str], w: int = 20, suffix: str = "_WMA",
            dropna: bool = True, max_rows: int | CutPoints | None = None) -> DataFrame:
    """Weights 1..w, newest heaviest; only full windows without nulls count."""
    cols, weight = names(cols), w * (w + 1) / 2

    def build(near):
        return {f"{c}{suffix}": _total([shift(c, j - w, near) * j for j in range(1, w + 1)]) / weight for c in cols}

    out = with_neighbours(df, s, o, w - 1, 0, build, max_rows)
    return complete_rows(out, [f"{c}{suffix}" for c in cols]) if dropna else out


def ewm_block(keep: float) -> int:
    """Rows a block may hold so that a weight can be divided out again within it."""
    return max(1, int(-100 / math.log10(keep)))


def win_ewm(df: DataFrame, s: Sequence[str], o: str, cols: Sequence[str], span: int, suffix: str = "_EW",
            max_rows: int | CutPoints | None = None) -> DataFrame:
    """Exponentially weighted mean with bias-corrected weights; nulls keep their place in time.

    A null row holds the mean of the rows before it, however long ago they are. Within a block the weighted
    sums are running sums with the weights divided out; from earlier blocks come the weighted sum and
    weight of the last two with known values. Anything older weighs less than 1e-99 of these.
    """
    if span < 1:
        raise ValueError("span must be at least 1")
    cols, keep = names(cols), 1 - 2 / (span + 1)
    if keep == 0:
        return fill_forward(df, s, o, {f"{c}{suffix}": F.col(f"`{c}`").cast("double") for c in cols}, max_rows)
    rows = ewm_block(keep)
    place = F.col(POS) - F.col(BLOCK) * rows
    numbered = number_rows(df, s, o, max_rows).withColumn(BLOCK, F.floor(F.col(POS) / rows))
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    one = {c: F.when(x[c].isNotNull(), F.lit(1.0)) for c in cols}

    def power(n: Column) -> Column:
        return F.pow(F.lit(keep), n)

    def before(c: str) -> Column:
        return F.last(f"_e{c}", ignorenulls=True).over(Window.partitionBy(*s).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))

    to_end = power(F.lit(rows - 1) - place)
    sums = numbered.groupBy(*s, BLOCK).agg(*[
        F.when(F.count(x[c]) > 0, F.struct(F.lit(0).alias("x"), F.sum(x[c] * to_end).alias("num"), F.sum(one[c] * to_end).alias("den"))).alias(f"_e{k}")
        for k, c in enumerate(cols)])
    ends = sums.withColumns({f"_e{k}": F.when(F.col(f"_e{k}").isNotNull(), F.struct(
        F.col(BLOCK).alias("at"), F.col(f"_e{k}.num").alias("num"), F.col(f"_e{k}.den").alias("den"))) for k in range(len(cols))})

    def with_previous(k: int) -> Column:
        own, prev = F.col(f"_e{k}"), before(str(k))
        decay = power((own["at"] - prev["at"]) * rows)
        return F.when(own.isNotNull(), F.struct(own["at"].alias("at"), (own["num"] + F.coalesce(decay * prev["num"], F.lit(0.0))).alias("num"),
                                                (own["den"] + F.coalesce(decay * prev["den"], F.lit(0.0))).alias("den")))

    paired = ends.withColumns({f"_e{k}": with_previous(k) for k in range(len(cols))})
    carried = paired.select(*s, BLOCK, *[before(str(k)).alias(f"_c{k}") for k in range(len(cols))])
    w = Window.partitionBy(*s, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def value(k: int, c: str) -> Column:
        num, den = F.sum(x[c] * power(-place)).over(w), F.sum(one[c] * power(-place)).over(w)
        carry = F.col(f"_c{k}")
        # the carried sums end with the last row of their block; both sides leave out this row's own power
        far = power((F.col(BLOCK) - carry["at"] - 1) * rows + 1)
        old_num, old_den = F.coalesce(carry["num"] * far, F.lit(0.0)), F.coalesce(carry["den"] * far, F.lit(0.0))
        return F.when(den.isNull(), carry["num"] / carry["den"]).otherwise((num + old_num) / (den + old_den))

    return _add(join_null_safe(numbered, carried, [*s, BLOCK], "left"), {f"{c}{suffix}": value(k, c) for k, c in enumerate(cols)}) \
        .drop(POS, LEN, BLOCK, *[f"_c{k}" for k in range(len(cols))])


def savgol_rows(window: int, order: int) -> np.ndarray:
    """Row ``i``: weights giving the fitted polynomial's value at place ``i`` of the window."""
    basis = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def win_savgol(df: DataFrame, s: Sequence[str], o: str, cols: Sequence[str], window: int = 5, order: int = 2,
               backfill: bool = True, suffix: str = "", short: str = "error",
               max_rows: int | CutPoints | None = None) -> DataFrame:
    """Savitzky-Golay filter, edges by the fit of the first and last window.

    A centred filter: row ``t`` sees ``window // 2`` later rows.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError("window must be odd and larger than order")
    cols, half, fit = names(cols), window // 2, savgol_rows(window, order)
    max_rows = _planned(df, s, o, max_rows)
    if backfill:
        df = fill_backward(df, s, o, {f"_f_{c}": F.col(c).cast("double") for c in cols}, max_rows)
    else:
        df = df.withColumns({f"_f_{c}": F.col(c).cast("double") for c in cols})

    def build(near):
        out = {}
        for c in cols:
            x = f"_f_{c}"
            value = _total([shift(x, j - half, near) * float(fit[half, j]) for j in range(window)])
            for e in range(half):
                left = _total([shift(x, j - e, near) * float(fit[e, j]) for j in range(window)])
                right = _total([shift(x, e + 1 - window + j, near) * float(fit[window - 1 - e, j])
                                for j in range(window)])
                value = F.when(near.pos == e, left).when(near.pos == near.length - 1 - e, right).otherwise(value)
            if short == "error":
                value = F.when(near.length < window, F.raise_error(F.lit(
                    "series is shorter than the smoothing window")).cast("double")).otherwise(value)
            else:
                value = F.when(near.length >= window, value).otherwise(F.col(f"`{c}`").cast("double") if short == "keep" else F.lit(None))
            out[f"{c}{suffix}"] = value
        return out

    smoothed = with_neighbours(df, s, o, window - 1, window - 1, build, max_rows)
    return smoothed.drop(*[f"_f_{c}" for c in cols])


def win_smooth_compare(df: DataFrame, s: Sequence[str], o: str, col: str, lo: str, hi: str, window: int = 5,
                       wma_window: int = 20, max_rows: int | CutPoints | None = None) -> DataFrame:
    """Original and four smoothers side by side; smoothing runs before the date range is cut."""
    max_rows = _planned(df, s, o, max_rows)
    out = win_ma(df, s, o, [col], window, max_rows=max_rows)
    out = win_wma(out, s, o, [col], wma_window, dropna=False, max_rows=max_rows)
    out = win_ewm(out, s, o, [col], window, max_rows=max_rows)
    out = win_savgol(out, s, o, [col], window, suffix="_SG", max_rows=max_rows)
    return out.filter(F.col(o).between(F.lit(lo).cast(df.schema[o].dataType), F.lit(hi).cast(df.schema[o].dataType)))


def win_pct_change(df: DataFrame, s: Sequence[str], o: str, col: str, out: str = "pct_change",
                   max_rows: int | CutPoints | None = None) -> DataFrame:
    """Change against the row before; gaps take the last known value first."""
    max_rows = _planned(df, s, o, max_rows)
    padded = fill_forward(df, s, o, {"_pad": F.col(col)}, max_rows)
    return with_neighbours(padded, s, o, 1, 0, lambda near: {
        out: pct_change("_pad", F.lag("_pad", 1).over(near.window))}, max_rows).drop("_pad")


def win_bfill(df, s, o, cols, max_rows=None):
    return fill(df, s, o, {c: F.col(c) for c in names(cols)}, False, max_rows)


def win_ffill(df, s, o, cols, max_rows=None):
    return fill(df, s, o, {c: F.col(c) for c in names(cols)}, True, max_rows)


def win_interpolate(df: DataFrame, s: Sequence[str], o: str, cols: Sequence[str], step: str = "W-MON",
                    anchors: str = "grid", max_rows: int | CutPoints | None = None, seq: str | None = None) -> DataFrame:
    """Series on a regular grid, gaps filled on the straight line between known neighbours.

    ``anchors='grid'`` knows only values whose time is itself a grid point (month starts that are
    not Mondays are lost); ``'all'`` lets every value pull the line. A leading gap stays null, a
    trailing gap holds the last value. Of the values of one time the first known one counts: the first
    by ``seq``, or the smallest where no order of arrival is named.
    """
    cols = names(cols)
    grid = series_grid(df, s, o, step, end_after=True)
    kind = grid.schema[o].dataType
    arrival = [F.col(seq)] if seq else []
    firsts = {c: F.col(f"`{c}`").cast("double") for c in cols}
    rows = df.groupBy(*s, F.col(o).cast(kind).alias(o)).agg(*[
        F.min_by(v, F.when(v.isNotNull(), F.struct(*arrival, v))).alias(c) for c, v in firsts.items()])
    if anchors == "grid":
        both = join_null_safe(grid, rows, [*s, o], "left").withColumn("_grid", F.lit(True))
    elif anchors == "all":
        # A value on a grid point merges with it by the aggregation.
        both = (grid.withColumn("_grid", F.lit(True)).unionByName(rows.withColumn("_grid", F.lit(False)), True)
                .groupBy(*s, o).agg(F.max("_grid").alias("_grid"), *[F.max(c).alias(c) for c in cols]))
    else:
        raise ValueError("anchors must be 'grid' or 'all'")
    unit = F.unix_date(F.col(o)) if step in GRID_START or step == "D" else F.unix_seconds(F.col(o).cast("timestamp"))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(unit.cast("double").alias("t"), F.col(c).alias("v")))
             for c in cols}
    max_rows = _planned(both, s, o, max_rows)
    both = fill(both, s, o, {f"_p_{c}": k for c, k in known.items()}, True, max_rows)
    both = fill(both, s, o, {f"_n_{c}": k for c, k in known.items()}, False, max_rows)
    out = []
    for c in cols:
        p, n, t = F.col(f"_p_{c}"), F.col(f"_n_{c}"), unit.cast("double")
        line = p["v"] + (n["v"] - p["v"]) * F.try_divide(t - p["t"], n["t"] - p["t"])
        out.append(F.when(F.col(c).isNotNull(), F.col(c)).when(n.isNull(), p["v"]).otherwise(line).alias(c))
    return both.filter("_grid").select(*s, o, *out)


def win_week_counter(df: DataFrame, s: Sequence[str], o: str, start: int = 5, out: str = "week",
                     max_rows: int | CutPoints | None = None) -> DataFrame:
    """Cyclic 1..52 counter by place, beginning at ``start``."""
    numbered = number_rows(df, s, o, max_rows)
    return numbered.withColumn(out, (F.pmod(F.col(POS) + start - 1, F.lit(52)) + 1).cast("int")).drop(POS, LEN)


def win_acf(df: DataFrame, s: Sequence[str], o: str, col: str, max_lag: int = 40,
            max_rows: int | CutPoints | None = None) -> DataFrame:
    """Rows ``(series, lag, acf, n)`` for lags 0..max_lag, with the overall mean in both factors.

    All lags come from one window pass; no self-join.
    """
    stats = df.groupBy(*s).agg(F.avg(col).alias("_m"), F.count(col).alias("n"))
    known = df.filter(F.col(col).isNotNull()).select(*s, o, F.col(col).cast("double").alias("_x"))
    centred = join_null_safe(known, stats, s).withColumn("_x", F.col("_x") - F.col("_m"))
    shifted = with_neighbours(centred, s, o, max_lag, 0, lambda near: {
        f"_{k}": F.col("_x") * (F.lag("_x", k).over(near.window) if k else F.col("_x"))
        for k in range(max_lag + 1)}, max_rows)
    sums = shifted.groupBy(*s).agg(F.max("n").alias("n"), *[
        F.coalesce(F.sum(f"_{k}"), F.lit(0.0)).alias(str(k)) for k in range(max_lag + 1)])
    sums = sums.withColumn("_var", F.col("0"))
    long = sums.unpivot([*s, "n", "_var"], [str(k) for k in range(max_lag + 1)], "lag", "_cov")
    return long.select(*s, F.col("lag").cast("int").alias("lag"),
                       F.try_divide("_cov", "_var").alias("acf"), "n").filter(F.col("lag") < F.col("n"))


def win_pacf(acf: DataFrame, s: Sequence[str]) -> DataFrame:
    """Partial autocorrelation from `win_acf` rows by the Durbin-Levinson recursion."""
    arrays = acf.groupBy(*s).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda e: e["acf"]).alias("_r"))

    def step(acc: Column, k: Column) -> Column:
        phi = acc["phi"]
        places = F.when(k > 1, F.sequence(F.lit(1), k - 1)).otherwise(F.array().cast("array<int>"))
        def dot(pick):
            return F.aggregate(places, F.lit(0.0), lambda t, j: t + F.get(phi, j - 1) * pick(j))
        r = F.col("_r")
        top = F.get(r, k) - dot(lambda j: F.get(r, k - j))
        last = F.try_divide(top, 1 - dot(lambda j: F.get(r, j)))
        new = F.transform(places, lambda j: F.get(phi, j - 1) - last * F.get(phi, k - j - 1))
        return F.struct(F.concat(new, F.array(last)).alias("phi"),
                        F.concat(acc["out"], F.array(last)).alias("out"))

    empty = F.array().cast("array<double>")
    lags = F.when(F.size("_r") > 1, F.sequence(F.lit(1), F.size("_r") - 1)).otherwise(F.array().cast("array<int>"))
    solved = F.aggregate(lags, F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("out")), step,
                         lambda acc: acc["out"])
    return arrays.select(*s, F.posexplode(solved).alias("lag", "pacf"))


def win_optimum_lag(acf: DataFrame, s: Sequence[str], max_lag: int = 40) -> DataFrame:
    """First lag whose autocorrelation is inside ``1.96/sqrt(n)``; the largest lag if none is."""
    inside = (F.col("lag") >= 1) & (F.abs("acf") < F.lit(1.96) / F.sqrt("n"))
    return acf.groupBy(*s).agg(F.coalesce(F.min(F.when(inside, F.col("lag"))), F.lit(max_lag)).alias("optimum_lag"))


def win_decompose(df: DataFrame, s: Sequence[str], o: str, col: str, period: int = 12,
                  max_rows: int | CutPoints | None = None) -> DataFrame:
    """Additive split into trend (centred average), seasonal (phase means, centred) and residual."""
    half = period // 2

    def build(near):
        x = F.col(col).cast("double")
        if period % 2:
            parts = [shift(col, j, near) for j in range(-half, half + 1)]
        else:
            parts = [shift(col, j, near) * (0.5 if abs(j) == half else 1.0) for j in range(-half, half + 1)]
        trend = _total([p.cast("double") for p in parts]) / period
        return {"trend": trend, "_detrended": x - trend, "_phase": F.pmod(near.pos, F.lit(period)).cast("int")}

    split = with_neighbours(df, s, o, half, half, build, max_rows)
    phases = split.groupBy(*s, "_phase").agg(F.avg("_detrended").alias("_pm"))
    centred = phases.select(*s, "_phase", (F.col("_pm") - F.avg("_pm").over(Window.partitionBy(*s))).alias("seasonal"))
    joined = join_null_safe(split, centred, [*s, "_phase"], "left")
    return joined.withColumn("resid", F.col("_detrended") - F.col("seasonal")).drop("_detrended", "_phase")


def win_infer_freq(df: DataFrame, s: Sequence[str], o: str, max_rows: int | CutPoints | None = None) -> DataFrame:
    """Most frequent gap between neighbouring times, in seconds; the smaller one on a tie."""
    secs = F.unix_seconds(F.col(o).cast("timestamp"))
    gaps = with_neighbours(df.select(*s, o), s, o, 1, 0, lambda near: {
        "_gap": secs - F.lag(secs, 1).over(near.window)}, max_rows).filter("_gap IS NOT NULL")
    counts = gaps.groupBy(*s, "_gap").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*s).agg(F.max_by("_gap", F.struct(F.col("_n"), -F.col("_gap"))).alias("gap_seconds"))


def win_last_n_vector(df: DataFrame, s: Sequence[str], o: str, col: str, n: int = 100, out: str = "history",
                      max_rows: int | CutPoints | None = None) -> DataFrame:
    """Last ``n`` non-null values newest first; rows with fewer are dropped."""
    known = df.filter(F.col(col).isNotNull())
    seen = with_neighbours(known, s, o, n - 1, 0, lambda near: {
        out: F.reverse(F.collect_list(col).over(near.window.rowsBetween(-(n - 1), 0)))}, max_rows)
    return seen.filter(F.size(out) == n)


def rolling_apply(df: DataFrame, s: Sequence[str], o: str, col: str, w: int, fn: Callable[[Column], Column],
                  out: str, max_rows: int | CutPoints | None = None) -> DataFrame:
    """User function over a full rolling window, given as an array column oldest first."""
    seen = with_neighbours(df, s, o, w - 1, 0, lambda near: {
        "_cells": F.collect_list(col).over(near.window.rowsBetween(-(w - 1), 0))}, max_rows)
    return seen.withColumn(out, F.when(F.size("_cells") == w, fn(F.col("_cells")))).drop("_cells")
