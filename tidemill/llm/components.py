"""Connected components of links between long ids, on Spark and, for the links of one task, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import settle

MAX_ROUNDS = 100


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i and j in place; a label is the smallest position of its class."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def _sign(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every id that has a link; root is the smallest id of its component.

    Alternating large and small stars: each round hangs neighbours under the smallest one known, first
    those above a node, then those below. Minima are taken with map-side combination, so a hub with any
    number of links is no single group, and every round's edges are a table in the checkpoint folder.
    """
    edges = settle(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    sign = _sign(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        below = large.join(lowest, "hi")
        small = below.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(lowest.select("hi", "m"))
        edges = settle(small.distinct())
        now = _sign(edges)
        if now == sign:
            roots = edges.select(F.col("lo").alias("node")).distinct()
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots.select("node", "node"))
        sign = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
