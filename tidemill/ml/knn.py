"""Exact nearest neighbours between two distributed frames.

Some train rows are pivots: the first is the train means, then rows far from all before them, then rows as
they come, all from a sample of ``PIVOT_ROWS`` rows. Every row knows its distances to all pivots. Train rows
are blocks: those nearest to one pivot, cut by their distance from it into pieces of about ``BLOCK_ROWS`` rows.
A block's smallest and largest distance to each pivot bound from below, by the triangle inequality, how near a
query can come to any of its rows; the largest of these bounds counts. A query first meets the blocks of the
smallest bound that hold k rows together. Its k-th distance there is an upper bound, and it then visits the other
blocks whose bound lies within that.

Queries meet the table of blocks, and later the rows of their blocks, in cogroups of bounded size: where one side is
longer it is dealt into pieces, and every pair of pieces is a task. A task hands on at most k rows a query and block, so
no pair of rows becomes a row of a DataFrame, and nothing is collected but the pivots' sample. The choice of
pivots changes what is visited, never the result. Gaps in features take the train means; train rows without a
target or key are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.layout import PIECE, complete_rows, cut_series, plan_cut
from tidemill.session import settle

BLOCK_ROWS = 4096
PIVOTS = 32
PIVOT_ROWS = 2_000
STRIP = 256
SLACK = 1e-9


@dataclass
class NearestNeighbours:
    train: DataFrame
    features: tuple[str, ...]
    y: str
    key: str
    k: int
    weights: str
    p: int

    def neighbours(self, queries: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """Rows ``(key, distance, train_key, y)``: the k nearest of each query row."""
        blocks, table, home = self.blocks(queries, key, block_rows)
        near = settle(self.choose(home, table, block_rows))
        first = settle(_best(self._meet(near, blocks, block_rows), self.k))
        seen = near.groupBy("_key").agg(F.collect_list("_b").alias("_seen"))
        far = F.when(F.size("_best") >= self.k, F.element_at("_best", -1)["_d"] * (1 + SLACK) + SLACK)
        reach = home.join(first.select("_key", far.alias("_far")), "_key", "left").join(seen, "_key", "left")
        second = self._meet(settle(self.choose(reach, table, block_rows, again=True)), blocks, block_rows)
        found = first.select("_key", F.inline("_best")).union(second.select("_key", "_d", "_tk", "_y"))
        return _best(found, self.k).select(F.col("_key").alias(key), F.inline("_best")).toDF(key, "distance", "train_key", "y")

    def blocks(self, queries: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Train rows with their block, the table of blocks, and the queries with their distances to the pivots."""
        rows = complete_rows(self.train.select(F.col(f"`{self.key}`").alias("_tk"), F.col(f"`{self.y}`").cast("double").alias("_y"), *self._cast()), ["_tk", "_y"])
        means = np.array([v or 0.0 for v in rows.agg(*[F.avg(f"x{i}") for i in range(len(self.features))]).first()], dtype=float)
        some = rows.select(*[f"x{i}" for i in range(len(means))]).limit(PIVOT_ROWS).toPandas().to_numpy(dtype=float)
        pivots = spread(np.where(np.isnan(some), means, some), means, self.p)
        placed = settle(self._placed(rows, means, pivots))
        plan = plan_cut(placed, ["_cell"], ["_t", "_tk"], block_rows)
        cut = cut_series(placed, ["_cell"], ["_t", "_tk"], plan).df
        number = F.col("_cell") * (plan.span + 1 if plan.points is not None else 1) + F.col(PIECE) + 1
        blocks = settle(cut.select("_tk", "_y", "_x", "_pd", number.cast("long").alias("_b")))
        ends = [F.array(*[f(F.col("_pd")[i]) for i in range(len(pivots))]).alias(n) for f, n in ((F.min, "_lo"), (F.max, "_hi"))]
        table = settle(blocks.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), *ends))
        asked = queries.select(F.col(f"`{key}`").alias("_key"), *self._cast())
        return blocks.drop("_pd"), table, settle(self._placed(asked, means, pivots).select("_key", "_x", "_pd"))

    def choose(self, home: DataFrame, table: DataFrame, block_rows: int = BLOCK_ROWS, again: bool = False) -> DataFrame:
        """Rows ``(_key, _x, _b)``: blocks of the smallest bounds that hold k rows, or with ``again`` the others within ``_far``."""
        kinds = dict(home.dtypes)
        sides = (home, "_key", max(1, ceil(home.count() / block_rows))), (table, "_b", max(1, ceil(table.count() / block_rows)))
        left, right = (_dealt(df, salt, F.lit(mine), F.lit(other), i == 0) for i, (df, salt, mine, other) in enumerate(
            (df, salt, n, sides[1 - i][2]) for i, (df, salt, n) in enumerate(sides)))
        return left.groupBy("_qp", "_tp").cogroup(right.groupBy("_qp", "_tp")).applyInPandas(
            chosen(self.k, again), f"_key {kinds['_key']}, _x array<double>, _b long")

    def transform(self, queries: DataFrame, key: str, out: str = "prediction") -> DataFrame:
        near = self.neighbours(queries, key)
        if self.weights == "uniform":
            value = F.avg("y")
        else:
            # A query that hits train rows exactly takes the mean of those rows.
            hit = F.col("distance") == 0
            inverse = F.try_divide(F.lit(1.0), F.col("distance"))
            weighted = F.sum(F.col("y") * inverse) / F.sum(inverse)
            value = F.when(F.max(hit), F.avg(F.when(hit, F.col("y")))).otherwise(weighted)
        return queries.join(near.groupBy(key).agg(value.alias(out)), key, "left")

    def _cast(self) -> list[Column]:
        return [F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, f in enumerate(self.features)]

    def _placed(self, df: DataFrame, means: np.ndarray, pivots: np.ndarray) -> DataFrame:
        """Features as one array, the distances to the pivots, the nearest pivot and how far it is."""
        kept = [c for c in df.columns if c[0] == "_"]
        kinds, p = dict(df.dtypes), self.p

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = pdf.iloc[:, len(kept):].to_numpy(dtype=float)
                x = np.where(np.isnan(x), means, x)
                d = np.stack([norm(x, pivot, p) for pivot in pivots], axis=1)
                cell = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=int)
                lists = {c: pd.Series(list(v), index=pdf.index, dtype=object) for c, v in (("_x", x), ("_pd", d))}
                yield pdf[kept].assign(**lists, _cell=cell, _t=d[np.arange(len(d)), cell])

        ordered = df.select(*kept, *[f"x{i}" for i in range(len(means))])
        return ordered.mapInPandas(place, ", ".join([*[f"{c} {kinds[c]}" for c in kept], "_x array<double>, _pd array<double>, _cell long, _t double"]))

    def _meet(self, visits: DataFrame, blocks: DataFrame, block_rows: int) -> DataFrame:
        """Candidates ``(_key, _d, _tk, _y)`` of every query in the blocks it visits: k at most for each pair of pieces."""
        counts = [df.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(n)) for df, n in ((visits, "_nq"), (blocks, "_nt"))]
        # blocks that no query visits stay out
        pieces = settle(counts[0].join(counts[1], "_b"))
        left = _dealt(visits.join(pieces, "_b"), "_key", F.col("_nq"), F.col("_nt"), True).drop("_nq", "_nt").groupBy("_b", "_qp", "_tp")
        right = _dealt(blocks.join(pieces, "_b"), "_tk", F.col("_nt"), F.col("_nq"), False).drop("_nq", "_nt").groupBy("_b", "_qp", "_tp")
        kinds = dict([*visits.dtypes, *blocks.dtypes])
        return left.cogroup(right).applyInPandas(nearest(self.k, self.p), f"_key {kinds['_key']}, _d double, _tk {kinds['_tk']}, _y double")


def norm(x: np.ndarray, to: np.ndarray, p: float) -> np.ndarray:
    return (np.abs(x - to) ** p).sum(axis=1) ** (1.0 / p)


def spread(sample: np.ndarray, start: np.ndarray, p: float, wanted: int = PIVOTS) -> np.ndarray:
    """``start``, then half of the wanted rows each as far as can be from those before it, then rows at even steps."""
    found = [start]
    gap = norm(sample, start, p)
    while len(found) < wanted // 2 and len(gap) and gap.max() > 0:
        found.append(sample[gap.argmax()])
        gap = np.minimum(gap, norm(sample, found[-1], p))
    even = sample[:: max(1, len(sample) // (wanted // 2))][: wanted // 2]
    return np.unique(np.vstack([np.array(found), even]) if len(even) else np.array(found), axis=0)


def _dealt(df: DataFrame, salt: str, mine: Column, others: Column, queries: bool) -> DataFrame:
    """Rows dealt into ``mine`` pieces, one copy for each of the other side's."""
    own, other = ("_qp", "_tp") if queries else ("_tp", "_qp")
    piece = F.pmod(F.xxhash64(F.col(salt), F.lit("piece")), mine).cast("int")
    return df.withColumn(own, piece).withColumn(other, F.explode(F.sequence(F.lit(0), (others - 1).cast("int"))))


def chosen(k: int, again: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def walk(queries: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or table.empty:
            return pd.DataFrame()
        ids, sizes = table["_b"].to_numpy(), table["_n"].to_numpy()
        lo, hi = np.stack(table["_lo"].to_list()), np.stack(table["_hi"].to_list())
        out = []
        for a in range(0, len(queries), STRIP):
            part = queries.iloc[a:a + STRIP]
            d = np.stack(part["_pd"].to_list())
            bound, middle = np.zeros((len(d), len(ids))), np.zeros((len(d), len(ids)))
            for i in range(d.shape[1]):
                own = d[:, i, None]
                np.maximum(bound, np.maximum(lo[:, i] - own, own - hi[:, i]), out=bound)
                middle += np.abs(own - (lo[:, i] + hi[:, i]) / 2)
            if again:
                far = part["_far"].fillna(np.inf).to_numpy(dtype=float)
                take = bound <= far[:, None]
                for row, seen in zip(take, part["_seen"]):
                    if seen is not None:
                        row[np.isin(ids, seen)] = False
            else:
                order = np.lexsort((middle, bound))
                held = np.cumsum(sizes[order], axis=1) - sizes[order]
                take = np.zeros_like(bound, dtype=bool)
                np.put_along_axis(take, order, held < k, axis=1)
            at, block = np.nonzero(take)
            # object columns: text inferred from values would come back in chunks
            out.append(pd.DataFrame({"_key": pd.Series(part["_key"].to_numpy(dtype=object)[at], dtype=object),
                                     "_x": pd.Series(part["_x"].to_numpy(dtype=object)[at], dtype=object), "_b": ids[block]}))
        return pd.concat(out)

    return walk


def _best(found: DataFrame, k: int) -> DataFrame:
    """``_key`` and its k nearest in order. A group holds k rows for each task that saw the query."""
    return found.groupBy("_key").agg(F.slice(F.sort_array(F.collect_list(F.struct("_d", "_tk", "_y"))), 1, k).alias("_best"))


def nearest(k: int, p: int):
    def walk(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or train.empty:
            return pd.DataFrame()
        # Equal distances go to the smaller train key: rows stand in key order and the sort is stable.
        train = train.sort_values("_tk", kind="stable")
        x, keys, ids, ys = (np.stack(train["_x"].to_list()), queries["_key"].to_numpy(dtype=object),
                            train["_tk"].to_numpy(dtype=object), train["_y"].to_numpy())
        q, take, out = np.stack(queries["_x"].to_list()), min(k, len(train)), []
        for a in range(0, len(q), STRIP):
            total = np.zeros((len(q[a:a + STRIP]), len(x)))
            for i in range(x.shape[1]):
                total += np.abs(q[a:a + STRIP, i, None] - x[None, :, i]) ** p
            distance = total ** (1.0 / p)
            pick = np.argsort(distance, axis=1, kind="stable")[:, :take]
            # object columns: text inferred from values would come back in chunks
            out.append(pd.DataFrame({"_key": pd.Series(np.repeat(keys[a:a + STRIP], take), dtype=object),
                                     "_d": np.take_along_axis(distance, pick, axis=1).ravel(),
                                     "_tk": pd.Series(ids[pick.ravel()], dtype=object), "_y": ys[pick.ravel()]}))
        return pd.concat(out)

    return walk


def fit_knn(train: DataFrame, features: Sequence[str], y: str, key: str, n_neighbors: int = 5,
            weights: str = "uniform", p: int = 2) -> NearestNeighbours:
    """``key`` names the train rows; it settles ties between equal distances. ``p`` is the norm, 1 at least."""
    if p < 1:
        raise ValueError("below 1 the distance has no triangle inequality")
    return NearestNeighbours(train, tuple(features), y, key, n_neighbors, weights, p)
