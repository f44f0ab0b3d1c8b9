"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Fingerprints
are cut into ``blocks`` bit blocks; two within the radius agree on at least ``blocks - radius`` of them,
so each choice of that many blocks is a table of candidates. More blocks mean longer keys but more
tables; their number is chosen from the number of fingerprints to keep the expected work least, and any
choice finds all links.

Candidates of a table are compared vertically: 64 fingerprints make one machine word per bit plane. A
query's distances to all 64 grow together in carry-save counters, plane by plane, and a block of 64 is
abandoned as soon as every counter exceeds the radius. A task hands on at most one link per fingerprint
(a spanning forest of what it found), never all pairs of a group.

Defined cases: a null or empty text has fingerprint zero, which is compared like any other; fewer words
than a shingle make one shingle of all; equal fingerprints are one node, whatever their number; rows
with a null id take part, and a component of such rows only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.batches import lists
from tidemill.llm.components import components, forest
from tidemill.llm.tiles import tiled
from tidemill.session import settle

BITS = 64
SEED = 42
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
TILE = 8_192
ROWS_A_GROUP = 40_000
ITEMS = 65_536
WORDS_AT_ONCE = 100_000


def text_fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - width + 1
    first, last = starts[:n].tolist(), (ends[width - 1:] - 1).tolist()
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, WORDS_AT_ONCE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(first[at:at + WORDS_AT_ONCE], last[at:at + WORDS_AT_ONCE])], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint(width: int = 4):
    @F.arrow_udf("long")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in lists(batches):
            yield pa.array(np.array([text_fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return sign


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def tables(blocks: int, radius: int) -> list[int]:
    """Bit masks; two fingerprints within the radius agree on all bits of at least one."""
    bounds = block_bounds(blocks)
    return [sum(((1 << (hi - lo)) - 1) << lo for lo, hi in chosen) for chosen in combinations(bounds, blocks - radius)]


def choose_blocks(n: int, radius: int, most: int = 4) -> int:
    def work(blocks: int) -> float:
        return comb(blocks, radius) * (200 + n / 2 ** (BITS * (blocks - radius) / blocks))

    return min(range(radius + 1, radius + 1 + most), key=work)


def planes(prints: np.ndarray) -> np.ndarray:
    """64 x blocks words: bit k of word [p, b] is bit p of fingerprint 64 * b + k."""
    padded = np.zeros(ceil(len(prints) / 64) * 64, dtype="<u8")
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64, BITS)
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(BITS, -1, 8).view("<u8")[:, :, 0]


def exceeded(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Which of the vertical counters are above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def near_masks(sliced: np.ndarray, valid: np.ndarray, queries: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For items (query, block of 64): positions of the items with a neighbour, and the bits of the neighbours."""
    left = np.arange(len(queries))
    counters = [np.zeros(len(queries), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = ~valid[block]
    for p in range(BITS):
        carry = sliced[p][block] ^ (np.uint64(0) - (queries >> np.uint64(p) & np.uint64(1)))
        for c in counters:
            c ^= carry
            carry &= ~c
        over |= carry
        if p % 4 == 3:
            over |= exceeded(counters, radius)
            open_ = over != ALL
            if open_.mean() < 0.8:
                left, queries, block, over = left[open_], queries[open_], block[open_], over[open_]
                counters = [c[open_] for c in counters]
                if not len(left):
                    break
    hit = over != ALL
    return left[hit], ~over[hit]


def link_group(segment: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within segments: pairs of fingerprints."""
    order = np.argsort(segment, kind="stable")
    segment, prints = segment[order], prints[order]
    edge = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True])))
    sizes = np.diff(edge)
    # every segment starts a new block of 64, so that a block belongs to one segment
    need = -(-sizes // 64)
    first_block = np.concatenate(([0], np.cumsum(need)))[:-1]
    within = np.arange(len(prints)) - np.repeat(edge[:-1], sizes)
    place = np.repeat(first_block, sizes) * 64 + within
    total = int(need.sum()) * 64
    laid, filled = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.uint64)
    laid[place], filled[place] = prints, ALL
    at = np.zeros(total, dtype=np.int64)
    at[place] = np.arange(len(prints))
    sliced, valid = planes(laid), planes(filled)[0]
    labels = np.arange(len(prints))
    own = place // 64
    last = np.repeat(first_block + need, sizes)
    todo = np.where(np.repeat(sizes, sizes) > 1, last - own, 0)
    bounds = np.concatenate(([0], np.cumsum(todo)))
    start = 0
    while start < len(prints):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + ITEMS, side="right")) - 1)
        n = todo[start:stop]
        if n.sum():
            who = np.repeat(np.arange(start, stop), n)
            block = own[who] + (np.arange(len(who)) - np.repeat(bounds[start:stop] - bounds[start], n))
            items, masks = near_masks(sliced, valid, prints[who], block, radius)
            for cut in range(0, len(items), 8_192):
                bits = np.unpackbits(masks[cut:cut + 8_192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, bit = np.nonzero(bits)
                forest(labels, who[items[cut:cut + 8_192]][row], at[block[items[cut:cut + 8_192]][row] * 64 + bit])
        start = stop
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return prints[moved], prints[labels[moved]]


def links(prints: DataFrame, col: str, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints that join exactly those within reach of each other."""
    n = prints.count()
    masks = tables(blocks or choose_blocks(n, radius), radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    entries = prints.select(F.col(col).alias("fp"), F.posexplode(F.array(*[F.col(col).bitwiseAND(F.lit(signed(m))) for m in masks])).alias("tab", "val"))
    dealt = tiled(entries, ["tab", "val"], "fp", TILE, ceil(n * len(masks) / ROWS_A_GROUP) or 1)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = link_group(rows["seg"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.select("grp", "seg", "fp").groupBy("grp").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4,
                    blocks: int | None = None) -> DataFrame:
    """doc_id, fp (signed 64-bit), component_id: smallest id reachable over links of at most ``radius`` bits, and root.

    ``root`` is the component's own name, a fingerprint in it: ids may be null or stand in several components."""
    signed = settle(docs.select(F.col(id_col).alias("doc_id"), fingerprint(width)(text_col).alias("fp")))
    nodes = settle(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, "fp", radius, blocks), "a", "b")
    rooted = settle(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.join(rooted.join(smallest, "root").select("fp", "component_id", "root"), "fp")
