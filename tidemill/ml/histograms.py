"""Counts of (feature bin, target bin) per block of rows, from which mutual information follows for any union of blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.layout import complete_rows

BINS = 10


@dataclass(frozen=True)
class Bins:
    """Bins of one column: of equal width between two values, or between given inner cut points."""

    low: float = 0.0
    high: float = 1.0
    cuts: tuple[float, ...] | None = None
    count: int = BINS

    def place(self, x: np.ndarray) -> np.ndarray:
        """-1 for an unknown value; values beyond the ends are in the first or last bin."""
        known = ~np.isnan(x)
        if self.cuts is not None:
            at = np.searchsorted(np.asarray(self.cuts), x, side="right")
        else:
            width = self.high - self.low
            with np.errstate(invalid="ignore", divide="ignore"):
                at = np.floor((x - self.low) / width * self.count) if width > 0 else np.zeros(len(x))
            at = np.nan_to_num(np.clip(at, 0, self.count - 1))
        return np.where(known, at, -1).astype(np.int64)


def joint_counts(df: DataFrame, features: Sequence[str], y: str, sets: Sequence[Sequence[Bins]], y_bins: Bins,
                 block_col: str | None = None) -> dict[int, np.ndarray]:
    """Per block an array (set, feature, feature bin, target bin), from one pass. Rows count for the features they know.

    Each of ``sets`` has the bins of all features; so several ways to cut them share the pass. What reaches the driver is
    ``sets * features * bins ** 2`` numbers a block, whatever the size of the data.
    """
    cols = [*features, y]
    block = F.col(block_col).cast("int") if block_col else F.lit(0)
    cast = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)]
    rows = complete_rows(df.select(block.alias("block"), *cast), [f"x{len(features)}"])
    size = max([b.count for s in sets for b in s] + [y_bins.count])
    d = len(features)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            blocks, values = pdf["block"].to_numpy(), pdf.iloc[:, 1:].to_numpy(dtype=float)
            by = y_bins.place(values[:, -1])
            for b in np.unique(blocks):
                mine = blocks == b
                total = sums.setdefault(int(b), np.zeros((len(sets), d, size * size)))
                for s, bins in enumerate(sets):
                    for j in range(d):
                        at = bins[j].place(values[mine, j])
                        known = at >= 0
                        total[s, j] += np.bincount(at[known] * size + by[mine][known], minlength=size * size)
        for b, total in sums.items():
            yield pd.DataFrame({"block": [b], "c": [total.ravel().tolist()]})

    cells = rows.mapInPandas(partial, "block int, c array<double>").select("block", F.posexplode("c").alias("i", "c")) \
        .where("c > 0").groupBy("block", "i").agg(F.sum("c").alias("c"))
    out: dict[int, np.ndarray] = {}
    for b, i, c in cells.collect():
        out.setdefault(b, np.zeros(len(sets) * d * size * size))[i] = c
    return {b: v.reshape(len(sets), d, size, size) for b, v in out.items()}


def mutual_information(counts: np.ndarray) -> np.ndarray:
    """Nats, for joint counts (feature, feature bin, target bin)."""
    n = counts.sum(axis=(1, 2), keepdims=True)
    expected = counts.sum(axis=2, keepdims=True) * counts.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(counts > 0, counts / n * np.log(counts * n / expected), 0.0)
    return np.maximum(part.sum(axis=(1, 2)), 0.0)
