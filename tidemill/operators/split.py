"""Ordering, top rows, train/test tails and time-ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.layout import LEN, POS, number_rows


def sort_time(df: DataFrame, o: str) -> DataFrame:
    return df.orderBy(F.col(o).asc_nulls_last())


def topk_recent(df: DataFrame, o: str, n: int, s: Sequence[str] = ()) -> DataFrame:
    """Latest ``n`` rows, overall or per series; ranks are cut before the shuffle."""
    if not s:
        return df.orderBy(F.col(o).desc()).limit(n)
    from pyspark.sql import Window

    w = Window.partitionBy(*s).orderBy(F.col(o).desc_nulls_last())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def topk_features(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of ``(feature, score)``; names break ties."""
    return scores.orderBy(F.col("score").desc_nulls_last(), "feature").limit(k)


def split_tail(df: DataFrame, s: Sequence[str], o: str, horizon: int, max_rows: int | None = None) -> DataFrame:
    """Flag the last ``horizon`` rows of each series as test; ``horizon`` numbers them from 1."""
    numbered = number_rows(df, s, o, max_rows)
    step = F.col(POS) - (F.col(LEN) - horizon) + 1
    return numbered.withColumns({
        "is_test": step >= 1,
        "horizon": F.when(step >= 1, step).cast("int"),
    }).drop(POS, LEN)


def split_exog(df: DataFrame, s: Sequence[str], o: str, horizon: int, target: str = "litres",
               max_rows: int | None = None) -> DataFrame:
    """Columns whose name does not hold the target's, with the tail flagged as future."""
    exog = df.select(*[c for c in df.columns if target not in c])
    return split_tail(exog, s, o, horizon, max_rows)


def split_ts_cv(df: DataFrame, s: Sequence[str], o: str, n_splits: int = 5, max_rows: int | None = None) -> DataFrame:
    """Add ``block``: fold ``i`` tests block ``i`` and trains on all blocks below it.

    Block 0 is the first ``n - n_splits * (n div (n_splits + 1))`` rows, never tested.
    """
    numbered = number_rows(df, s, o, max_rows)
    size = F.floor(F.col(LEN) / (n_splits + 1))
    head = F.col(LEN) - size * n_splits
    block = F.when((F.col(POS) < head) | (size == 0), 0).otherwise(
        F.floor(F.try_divide(F.col(POS) - head, size)) + 1)
    return numbered.withColumn("block", block.cast("int")).drop(POS, LEN)


def head_slice(df: DataFrame, s: Sequence[str], o: str, first: int | None = None, drop_last: int = 0,
               max_rows: int | None = None) -> DataFrame:
    """First ``first`` rows, or all but the last ``drop_last``, per series."""
    numbered = number_rows(df, s, o, max_rows)
    keep = F.col(POS) < F.col(LEN) - drop_last
    if first is not None:
        keep = keep & (F.col(POS) < first)
    return numbered.filter(keep).drop(POS, LEN)
