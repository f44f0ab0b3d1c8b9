"""Embedding near-duplicates: subspace pigeonhole join.

Unit vectors within cosine ``c`` are within squared distance ``2 - 2c``. A seeded rotation spreads that
distance evenly, and the rotated vector is split into blocks of ``BLOCK`` dimensions. Two near vectors
are near in at least one block, within the block's share of the squared distance. Each block is a range
join: vectors go to cells as wide as the block's radius along one coordinate and to the next cell, so two
in reach meet in exactly one cell; there a sorted second coordinate and the block distance leave
few candidates, and these are verified with the whole vectors in double precision. A pair counts in the
first block in which it is near, so the union over the blocks needs no deduplication.

Exact copies are one node with a weight. Cells with many vectors are split into pairs of chunks
(``tiled``), so a label or a cluster with a third of all rows is many tasks, and what a task hands on is a
count per node and at most one link per node, never the pairs of a group.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a
null label, link with nothing; vectors of different lengths do not link; repeated rows are linked copies;
a null id takes part, and a component of such rows only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components, forest
from tidemill.llm.tiles import tiled
from tidemill.session import settle

BLOCK = 8
TILE = 4_096
ROWS_A_GROUP = 8_192
STRIP = 512
PAIRS = 50_000
SLACK = 1e-9
FOUND = "node long, other long, links long"


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def spans(dim: int) -> list[slice]:
    return [slice(k, min(k + BLOCK, dim)) for k in range(0, dim, BLOCK)]


def budget(dim: int, block: slice, least: float) -> float:
    return (2 - 2 * least) * (block.stop - block.start) / dim + SLACK


def cell_udf(least: float):
    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out: list[list[int] | None] = [None] * len(vectors)
            lengths = vectors.map(len)
            for dim in lengths.unique():
                rows = np.flatnonzero(lengths == dim)
                turned = unit(np.stack(vectors.iloc[rows].to_list()).astype(np.float64)) @ rotation(int(dim))
                blocks = spans(int(dim))
                width = np.sqrt([budget(int(dim), b, least) for b in blocks])
                places = np.floor(turned[:, [b.start for b in blocks]] / width).astype(np.int32)
                for row, place in zip(rows, places.tolist()):
                    out[row] = place
            yield pd.Series(out, dtype=object)

    return cells


def verified(turned: np.ndarray, i: np.ndarray, j: np.ndarray, vectors: np.ndarray, block: int, least: float) -> np.ndarray:
    """Of candidate pairs, those whose cosine is high enough and that no earlier block finds."""
    dim = vectors.shape[1]
    good = np.empty(len(i), dtype=bool)
    blocks = spans(dim)
    for a in range(0, len(i), PAIRS):
        x, y = vectors[i[a:a + PAIRS]], vectors[j[a:a + PAIRS]]
        near = np.einsum("ij,ij->i", x, y) >= least * np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        left = np.flatnonzero(near)
        gap = turned[i[a:a + PAIRS][left]] - turned[j[a:a + PAIRS][left]]
        for b in blocks[:block]:
            near[left] &= (gap[:, b] ** 2).sum(axis=1) > budget(dim, b, least)
        good[a:a + PAIRS] = near
    return good


def join_segment(vectors: np.ndarray, home: np.ndarray, chunk: np.ndarray, cross: bool, block: int, least: float):
    """Linked pairs of one cell: blocks of (i, j)."""
    dim = vectors.shape[1]
    turned = unit(vectors) @ rotation(dim)
    span = spans(dim)[block]
    low, reach = turned[:, span], budget(dim, span, least)
    order = np.argsort(low[:, -1], kind="stable")
    key = low[order, -1]
    size = (low * low).sum(axis=1)
    for a in range(0, len(order), STRIP):
        strip = order[a:a + STRIP]
        end = int(np.searchsorted(key, key[min(a + STRIP, len(order)) - 1] + np.sqrt(reach), side="right"))
        other = order[a:end]
        close = size[strip][:, None] + size[other][None, :] - 2 * low[strip] @ low[other].T <= reach
        close &= np.arange(len(other))[None, :] > np.arange(len(strip))[:, None]
        close &= home[strip][:, None] | home[other][None, :]
        if cross:
            close &= chunk[strip][:, None] != chunk[other][None, :]
        x, y = np.nonzero(close)
        good = verified(turned, strip[x], other[y], vectors, block, least)
        if good.any():
            yield strip[x[good]], other[y[good]]


def compare(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("seg", sort=False):
            vectors = np.stack(part["embedding"].to_list()).astype(np.float64)
            nodes, weight = part["node"].to_numpy(), part["n"].to_numpy()
            # one node may stand in a segment twice, at home and as a neighbour's copy
            ids, spot = np.unique(nodes, return_inverse=True)
            labels, links = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
            for i, j in join_segment(vectors, part["home"].to_numpy(), part["chunk"].to_numpy(), bool(part["cross"].iloc[0]), int(part["block"].iloc[0]), least):
                np.add.at(links, spot[i], weight[j])
                np.add.at(links, spot[j], weight[i])
                forest(labels, spot[i], spot[j])
            hit = np.flatnonzero(links)
            out.append(pd.DataFrame({"node": ids[hit], "other": ids[labels[hit]], "links": links[hit]}))
        return pd.concat(out)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row a vector."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")) \
        .withColumn("usable", F.coalesce(F.col("label").isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False)))
    reps = settle(rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
                  .withColumn("node", F.monotonically_increasing_id()))
    count = reps.count()
    placed = reps.select("node", "n", "label", "embedding", F.size("embedding").alias("dim"), F.posexplode(cell_udf(least)("embedding")).alias("block", "cell"))
    twice = placed.select("node", "n", "label", "embedding", "dim", "block", F.explode(F.array(
        F.struct(F.col("cell").alias("cell"), F.lit(True).alias("home")), F.struct((F.col("cell") + 1).alias("cell"), F.lit(False).alias("home")))).alias("c")) \
        .select("*", "c.cell", "c.home").drop("c")
    blocks = reps.agg(F.max(F.size("embedding"))).first()[0] or BLOCK
    groups = ceil(2 * count * ceil(blocks / BLOCK) / ROWS_A_GROUP) or 1
    dealt = tiled(twice, ["label", "dim", "block", "cell"], "node", TILE, groups)
    found = settle(dealt.select("grp", "seg", "chunk", "cross", "node", "n", "embedding", "block", "home").groupBy("grp").applyInPandas(compare(least), FOUND))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "other")
    rooted = settle(reps.join(links, "node", "left").join(roots, "node", "left")
                    .select("label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(smallest, "root").select("label", "embedding", "n_links", "component_id")
    joined = rows.where("usable").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
