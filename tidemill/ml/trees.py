"""Many regression trees at once, from split histograms.

Rows are binned once. Each level of all trees, whatever folds, draws and forests they belong to, is then one pass:
a task adds its rows up by (tree, open node, feature, bin), the sums of a node meet in one task, which takes
the best cut, and only the cuts reach the driver, a row a node. Levels whose sums would take more than
``CELLS`` numbers a task are done in several passes.

Whatever is random in a tree (rows drawn for it, features a node looks at, random cut points) follows
from its seed and the node's place, so a tree grown among others is the tree grown alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.layout import complete_rows
from tidemill.operators.quantiles import quantile_values
from tidemill.session import settle

N_BINS = 32
CELLS = 8_000_000
ROWS_A_TASK = 20_000
MAX_DEPTH = 30
LEAF = -1
# Chances of being drawn 0, 1, 2, ... times when as many rows are drawn as there are
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 random-looking bits of each number."""
    z = (x + np.uint64((seed + 1) % 2 ** 32)) * np.uint64(0x9E3779B97F4A7C15)  # fixed values: a mixing of 64 bits
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(bits: np.ndarray) -> np.ndarray:
    return (bits >> np.uint64(11)).astype(float) / 2 ** 53


@dataclass(frozen=True)
class Job:
    """One tree: its rows (blocks before ``fold``; all for None), its features and how it grows."""

    fold: int | None = None
    seed: int = 42
    depth: int = 5
    min_instances: int = 1
    subset: int | None = None  # features a node looks at
    allowed: tuple[int, ...] | None = None
    bootstrap: bool = False
    random_cut: bool = False

    def features(self, d: int, paths: Sequence[int]) -> np.ndarray:
        """The features that the nodes of some paths look at, a row a node."""
        own = np.arange(d) if self.allowed is None else np.asarray(self.allowed, dtype=int)
        if self.subset is None or self.subset >= len(own):
            return np.broadcast_to(own, (len(paths), len(own)))
        draw = mixed(mixed(np.asarray(paths, dtype=np.uint64), self.seed)[:, None] ^ own.astype(np.uint64), 1)
        return own[np.sort(np.argsort(draw, axis=1)[:, :self.subset], axis=1)]

    def weights(self, rows: np.ndarray) -> np.ndarray:
        if not self.bootstrap:
            return np.ones(len(rows))
        return np.searchsorted(POISSON, uniform(mixed(rows.astype(np.uint64), self.seed)), side="right").astype(float)


@dataclass
class Tree:
    """Nodes by number, the first one on top. A row goes left where its bin is at most ``cut``."""

    feature: list[int] = field(default_factory=lambda: [LEAF])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    path: list[int] = field(default_factory=lambda: [1])

    def add(self, value: float, path: int) -> int:
        for column, v in zip((self.feature, self.cut, self.left, self.right, self.value, self.gain, self.path), (LEAF, 0, 0, 0, value, 0.0, path)):
            column.append(v)
        return len(self.feature) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins."""
        at = np.zeros(len(bins), dtype=np.int64)
        feature, cut, left, right = (np.asarray(c) for c in (self.feature, self.cut, self.left, self.right))
        live = np.arange(len(bins)) if feature[0] != LEAF else np.zeros(0, dtype=int)
        while len(live):
            node = at[live]
            at[live] = np.where(bins[live, feature[node]] <= cut[node], left[node], right[node])
            live = live[feature[at[live]] != LEAF]
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.nodes(bins)]

    def importance(self, d: int) -> np.ndarray:
        out = np.zeros(d)
        inner = [k for k, f in enumerate(self.feature) if f != LEAF]
        np.add.at(out, [self.feature[k] for k in inner], [self.gain[k] for k in inner])
        return out / out.sum() if out.sum() > 0 else out


@dataclass
class Binned:
    """Settled rows: block, row, y (less ``centre``), bins (a byte a feature)."""

    rows: DataFrame
    cuts: list[np.ndarray]
    fill: list[float]
    centre: float


def to_bins(values: np.ndarray, cuts: Sequence[np.ndarray], fill: Sequence[float]) -> np.ndarray:
    """Bins of features (columns); an unknown value is taken for the mean."""
    out = np.zeros(values.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        x = values[:, j]
        out[:, j] = np.searchsorted(c, np.where(np.isnan(x), fill[j], x), side="left")
    return out


def doubles(features: Sequence[str]) -> list[Column]:
    return [F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, f in enumerate(features)]


def bin_rows(df: DataFrame, features: Sequence[str], y: str, block_col: str | None = None, n_bins: int = N_BINS) -> Binned:
    """Cut points at the quantiles of all rows; every row with a target stays."""
    d = len(features)
    block = F.col(block_col).cast("int") if block_col else F.lit(0)
    rows = df.select(block.alias("block"), *doubles(features), F.col(f"`{y}`").cast("double").alias("y"))
    rows = complete_rows(rows, ["y"]).where(~F.isnan("y"))
    means = rows.agg(*[F.avg(f"x{i}") for i in range(d)], F.avg("y"), F.count(F.lit(1))).first()
    fill, centre = [float(m or 0.0) for m in means[:d]], float(means[d] or 0.0)
    table = quantile_values(rows, [f"x{i}" for i in range(d)], [k / n_bins for k in range(1, n_bins)])
    cuts = [np.unique(table.get(f"x{i}", [0.0])) for i in range(d)]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = to_bins(pdf[[f"x{i}" for i in range(d)]].to_numpy(dtype=float), cuts, fill)
            yield pd.DataFrame({"block": pdf["block"], "row": pdf["row"], "y": pdf["y"] - centre, "bins": [b.tobytes() for b in bins]})

    # A task sends its sums of every open node, however few its rows are.
    numbered = rows.repartition(max(1, -(-means[d + 1] // ROWS_A_TASK))).withColumn("row", F.monotonically_increasing_id())
    return Binned(settle(numbered.mapInPandas(place, "block int, row long, y double, bins binary")), cuts, fill, centre)


def _arrays(pdf: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(pdf["bins"]), dtype=np.uint8).reshape(len(pdf), d)
    return pdf["block"].to_numpy(), pdf["row"].to_numpy(), pdf["y"].to_numpy(), bins


def grow(binned: Binned, jobs: Sequence[Job]) -> list[Tree]:
    trees = [Tree() for _ in jobs]
    open_nodes: dict[int, list[int]] = {t: [0] for t in range(len(jobs))}
    d = len(binned.cuts)
    level = 0
    while open_nodes:
        found = {}
        for chunk in _chunks(open_nodes, jobs, d):
            found.update(_best_cuts(binned, jobs, trees, chunk))
        following: dict[int, list[int]] = {}
        for (t, node), (feature, cut, gain, wl, sl, wr, sr) in sorted(found.items()):
            tree, job = trees[t], jobs[t]
            if node == 0:
                tree.value[0] = (sl + sr) / (wl + wr) if wl + wr > 0 else 0.0
            if feature < 0 or level >= job.depth:
                continue
            tree.feature[node], tree.cut[node], tree.gain[node] = int(feature), int(cut), gain
            tree.left[node] = tree.add(sl / wl, 2 * tree.path[node])
            tree.right[node] = tree.add(sr / wr, 2 * tree.path[node] + 1)
            if level + 1 < job.depth:
                for child, weight in ((tree.left[node], wl), (tree.right[node], wr)):
                    if weight >= 2 * job.min_instances:
                        following.setdefault(t, []).append(child)
        open_nodes = following
        level += 1
    for tree in trees:
        tree.value = [v + binned.centre for v in tree.value]
    return trees


def _chunks(open_nodes: dict[int, list[int]], jobs: Sequence[Job], d: int) -> Iterator[dict[int, list[int]]]:
    chunk, size = {}, 0
    for t, nodes in open_nodes.items():
        each = 2 * N_BINS * (jobs[t].subset or len(jobs[t].allowed or range(d)))
        a = 0
        while a < len(nodes):
            if size >= CELLS:
                yield chunk
                chunk, size = {}, 0
            b = min(len(nodes), a + max(1, (CELLS - size) // each))
            chunk[t] = nodes[a:b]
            size += (b - a) * each
            a = b
            if a < len(nodes):
                size = CELLS
    if chunk:
        yield chunk


def _best_cuts(binned: Binned, jobs: Sequence[Job], trees: Sequence[Tree], chunk: dict[int, list[int]]) -> dict[tuple[int, int], tuple]:
    d = len(binned.cuts)
    given = binned.rows.sparkSession.sparkContext.broadcast([(t, jobs[t], trees[t], nodes) for t, nodes in chunk.items()])
    of_job = {t: jobs[t] for t in chunk}
    paths = {(t, n): trees[t].path[n] for t, nodes in chunk.items() for n in nodes}

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = []
        for t, job, tree, nodes in given.value:
            looked = job.features(d, [tree.path[n] for n in nodes])
            place = np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            plans.append((t, job, tree, nodes, looked, place, np.zeros((2, len(nodes) * looked.shape[1] * N_BINS))))
        for pdf in batches:
            block, row, y, bins = _arrays(pdf, d)
            for t, job, tree, nodes, looked, place, sums in plans:
                mine = np.arange(len(y)) if job.fold is None else np.flatnonzero(block < job.fold)
                at = place[tree.nodes(bins[mine])]
                mine, at = mine[at >= 0], at[at >= 0]
                w = job.weights(row[mine])
                if job.bootstrap:
                    mine, at, w = mine[w > 0], at[w > 0], w[w > 0]
                if not len(mine):
                    continue
                k = looked.shape[1]
                cell = ((at[:, None] * k + np.arange(k)) * N_BINS + bins[mine[:, None], looked[at]]).ravel()
                sums[0] += np.bincount(cell, np.repeat(w, k), minlength=sums.shape[1])
                sums[1] += np.bincount(cell, np.repeat(w * y[mine], k), minlength=sums.shape[1])
        out: list[tuple] = []
        for t, job, tree, nodes, looked, place, sums in plans:
            lots = sums.reshape(2, len(nodes), -1)
            out += [(t, nodes[i], lots[:, i].ravel()) for i in np.flatnonzero(lots[0].any(axis=1))]
            if len(out) >= 1_000:
                yield pd.DataFrame(out, columns=["t", "node", "h"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["t", "node", "h"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for t, node, h in zip(pdf["t"], pdf["node"], pdf["h"]):
                total[t, node] = total[t, node] + h if (t, node) in total else np.array(h)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for key, h in total.items():
            by_size.setdefault(len(h), []).append(key)
        for keys in by_size.values():
            for a in range(0, len(keys), 2_000):
                some = keys[a:a + 2_000]
                best = _best([of_job[t] for t, _ in some], [paths[k] for k in some], d, np.array([total[k] for k in some]))
                yield pd.DataFrame({"t": [t for t, _ in some], "node": [n for _, n in some], **best})

    sums = binned.rows.mapInPandas(add_up, "t int, node int, h array<double>").repartition("t", "node")
    cuts = sums.mapInPandas(choose, "t int, node int, feature int, cut int, gain double, wl double, sl double, wr double, sr double")
    return {(r[0], r[1]): tuple(r[2:]) for r in cuts.collect()}


def _best(jobs: Sequence[Job], paths: Sequence[int], d: int, h: np.ndarray) -> dict[str, np.ndarray]:
    """For nodes that look at as many features each: feature (-1 for none), cut, gain and the sums on both sides."""
    n = len(jobs)
    k = h.shape[1] // (2 * N_BINS)
    w, s = np.moveaxis(h.reshape(n, 2, k, N_BINS), 1, 0)
    looked = np.empty((n, k), dtype=int)
    of_job: dict[Job, list[int]] = {}
    for i, job in enumerate(jobs):
        of_job.setdefault(job, []).append(i)
    for job, mine in of_job.items():
        looked[mine] = job.features(d, [paths[i] for i in mine])
    whole, total = w[:, 0].sum(axis=1)[:, None, None], s[:, 0].sum(axis=1)[:, None, None]
    wl, sl = np.cumsum(w, axis=2)[:, :, :-1], np.cumsum(s, axis=2)[:, :, :-1]
    wr, sr = whole - wl, total - sl
    least = np.array([max(j.min_instances, 1e-9) for j in jobs])[:, None, None]
    good = (wl >= least) & (wr >= least)
    drawn = np.array([j.random_cut for j in jobs])
    if drawn.any():
        first = (w > 0).argmax(axis=2)
        last = N_BINS - 1 - (w[:, :, ::-1] > 0).argmax(axis=2)
        seeds = np.array([mixed(np.array([p], dtype=np.uint64), j.seed)[0] for p, j in zip(paths, jobs)])
        at = first + np.floor(uniform(mixed(seeds[:, None] ^ looked.astype(np.uint64), 2)) * (last - first)).astype(int)
        good &= ~drawn[:, None, None] | (np.arange(N_BINS - 1) == at[:, :, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(good, sl ** 2 / wl + sr ** 2 / wr - total ** 2 / whole, -np.inf).reshape(n, -1)
    at, rows = gain.argmax(axis=1), np.arange(n)
    gained = gain[rows, at]
    found = gained > 1e-9 * np.abs(total ** 2 / whole)[:, 0, 0] + 1e-300
    pick = [v.reshape(n, -1)[rows, at] for v in (wl, sl, wr, sr)]
    none = [whole[:, 0, 0], total[:, 0, 0], np.zeros(n), np.zeros(n)]
    sides = [np.where(found, p, q) for p, q in zip(pick, none)]
    return {"feature": np.where(found, looked[rows, at // (N_BINS - 1)], -1), "cut": np.where(found, at % (N_BINS - 1), 0),
            "gain": np.where(found, gained, 0.0), "wl": sides[0], "sl": sides[1], "wr": sides[2], "sr": sides[3]}


@dataclass
class TreeModel:
    """The mean of some trees on raw features."""

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    fill: list[float]
    trees: list[Tree]

    def column(self) -> Column:
        cuts, fill, trees = self.cuts, self.fill, self.trees

        @F.pandas_udf("double")
        def predict(*xs: pd.Series) -> pd.Series:
            bins = to_bins(np.column_stack([x.to_numpy(dtype=float) for x in xs]), cuts, fill)
            return pd.Series(sum(t.predict(bins) for t in trees) / len(trees))

        return predict(*doubles(self.features))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.column())


def fold_errors(binned: Binned, fits: Sequence[tuple[int, Sequence[Tree]]]) -> list[tuple[float, float, float]]:
    """(R2 on the fold's block, error before it, error on it) of fits (fold, trees), all from one pass."""
    d, centre = len(binned.cuts), binned.centre
    given = binned.rows.sparkSession.sparkContext.broadcast(list(fits))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(given.value), 2, 4))
        for pdf in batches:
            block, _, y, bins = _arrays(pdf, d)
            for e, (fold, trees) in enumerate(given.value):
                mine = np.flatnonzero(block <= fold)
                if not len(mine):
                    continue
                miss = (y[mine] + centre - sum(t.predict(bins[mine]) for t in trees) / len(trees)) ** 2
                for side, held in enumerate((block[mine] < fold, block[mine] == fold)):
                    sums[e, side] += [held.sum(), y[mine][held].sum(), (y[mine][held] ** 2).sum(), miss[held].sum()]
        for e, side in zip(*np.nonzero(sums[:, :, 0])):
            yield pd.DataFrame([(int(e), int(side), *sums[e, side])], columns=["e", "side", "n", "y", "yy", "sse"])

    rows = binned.rows.mapInPandas(add_up, "e int, side int, n double, y double, yy double, sse double") \
        .groupBy("e", "side").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "sse")]).collect()
    got = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    out = []
    for e in range(len(fits)):
        (n0, _, _, sse0), (n1, y1, yy1, sse1) = got.get((e, 0), (0, 0, 0, 0)), got.get((e, 1), (0, 0, 0, 0))
        spread = yy1 - y1 ** 2 / n1 if n1 else 0.0
        out.append((1 - sse1 / spread if spread > 0 else float("nan"), sse0 / n0 if n0 else float("nan"), sse1 / n1 if n1 else float("nan")))
    return out


def subset_size(name: str | None, d: int) -> int | None:
    """How many of d features a node looks at."""
    if name is None or name == "all":
        return None
    sizes = {"sqrt": np.sqrt(d), "log2": np.log2(max(d, 2)), "onethird": d / 3}
    return max(1, int(np.ceil(sizes[name] if name in sizes else float(name) * d)))


def importances(binned: Binned, folds: Sequence[int | None], seed: int = 42, num_trees: int = 100, depth: int = 5,
                subset: str = "onethird") -> dict[int | None, np.ndarray]:
    """Forest importance of every feature for each fold: all forests grow together."""
    d = len(binned.cuts)
    jobs = [Job(fold, seed * 1_000 + k, depth, 1, subset_size(subset, d), None, True) for fold in folds for k in range(num_trees)]
    trees = grow(binned, jobs)
    out = {}
    for i, fold in enumerate(folds):
        total = sum(t.importance(d) for t in trees[i * num_trees:(i + 1) * num_trees])
        out[fold] = total / total.sum() if total.sum() > 0 else total
    return out
