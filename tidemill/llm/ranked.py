"""Ranked lexical search with range-maximum tables over posting lists.

Given queries (items) are searched against all documents. One pass over the texts writes blocks of postings
for the words of the queries; each block holds some thousand documents. Counts of documents and words over
all blocks give the weights. Within a block every posting list has a sparse table that answers where the
largest impact of any range lies. A query starts from the interval of all documents of a block, whose bound
is the sum of its lists' maxima. The intervals with the highest bounds are split at the document of their
largest impact: that document is scored exactly, and the parts on its two sides get bounds from their own
range maxima. The search ends where no bound reaches what is found, so the rows are those of a full scan.

Blocks are searched twice: a probe of a few rounds yields, over all blocks, a score that the k-th result
reaches at least; the whole search then drops every interval below it at once. Blocks hand on at most k rows
a query, so groups of copies with one score, of any size, cost no more than others.

Memory: a block has at most ``BLOCK_DOCS`` documents and about ``BLOCK_POSTINGS`` postings. Queries are dealt
into groups of about ``GROUP_CHARS`` characters; only a group's words and weights are sent to tasks.

Defined cases: a null text has no words; documents without a word count nowhere; every row is a document of its
own, also where ids repeat; of equal scores the smallest id comes first, null ids last; every row of the
queries' table is a query; a query without a word of any document has no rows; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.batches import STEP
from tidemill.session import settle

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# upper case to lower case, what is no letter, digit or part of another character to a blank
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 1_000_000
GROUP_CHARS = 4_000_000
CELLS = 1 << 14  # of intervals times words that are worked on at once
MOST = 64  # intervals split at once
PROBE_ROUNDS = 9
INDEX = "ids array<long>, sizes array<long>, terms array<int>, counts array<int>, places array<int>, tfs array<long>, n_docs long, n_words long"
FOUND = "query int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


# -- index


def index(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """Blocks of postings of the vocabulary's words, by their place in it; every document with a word is in one."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(words.value)}.get
        ids, sizes, found, n_postings = [], [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    tokens = (text or b"").translate(FOLD).split()
                    if not tokens:
                        continue
                    counts = Counter(map(place, tokens))
                    counts.pop(None, None)
                    ids.append(i)
                    sizes.append(len(tokens))
                    found.append(counts)
                    n_postings += len(counts)
                    if len(ids) >= BLOCK_DOCS or n_postings >= BLOCK_POSTINGS:
                        yield pack(ids, sizes, found)
                        ids, sizes, found, n_postings = [], [], [], 0
        if ids:
            yield pack(ids, sizes, found)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(build, INDEX)


def pack(ids: list, sizes: list[int], found: list[Counter]) -> pa.RecordBatch:
    per_doc = np.array([len(c) for c in found], dtype=np.int64)
    terms = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(per_doc.sum()))
    tfs = np.fromiter(chain.from_iterable(c.values() for c in found), dtype=np.int64, count=len(terms))
    order = np.argsort(terms, kind="stable")
    kinds, counts = np.unique(terms, return_counts=True)
    places = np.repeat(np.arange(len(ids), dtype=np.int32), per_doc)[order]
    values = [ids, sizes, kinds.tolist(), counts.astype(np.int32), places, tfs[order]]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = ["ids", "sizes", "terms", "counts", "places", "tfs", "n_docs", "n_words"]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(t)) for v, t in zip(values, types)] + [pa.array([len(ids)]), pa.array([sum(sizes)])], names=names)


# -- one block


class Block:
    """Posting lists of some documents, in the order of their ids, with a sparse table of maxima."""

    def __init__(self, ids: list, sizes: np.ndarray, terms: np.ndarray, places: np.ndarray, tfs: np.ndarray, weights: np.ndarray, norm):
        """``terms``, ``places``, ``tfs``: one entry a posting. ``norm``: the m of document sizes."""
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        self.ids = [ids[k] for k in order]
        self.n = len(ids)
        rank = np.empty(self.n, dtype=np.int64)
        rank[order] = np.arange(self.n)
        keys = terms.astype(np.int64) * self.n + rank[places]
        by_key = np.argsort(keys, kind="stable")
        self.keys = keys[by_key]
        self.places = self.keys % self.n
        m, tf = norm(sizes)[places[by_key]], tfs[by_key]
        if len(tf) and int(tf.max()) > 2 ** 33:
            raise OverflowError("a word occurs too often in one document for 64-bit scores")
        self.impact = weights[terms[by_key]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        self.table = [np.arange(len(keys), dtype=np.int32)]
        longest = int(np.bincount(terms).max()) if len(terms) else 0
        width = 1
        while 2 * width <= longest:
            left = self.table[-1]
            right = np.concatenate((left[width:], left[-1:].repeat(width)))
            self.table.append(np.where(self.impact[right] > self.impact[left], right, left))
            width *= 2
        self.table = np.stack(self.table)
        self.log = np.zeros(longest + 2, dtype=np.int8)
        for k in range(2, longest + 2):
            self.log[k] = self.log[k // 2] + 1

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the largest impact of each range a..b of postings lies, the first of equals; any place for an empty range."""
        level = self.log[np.maximum(b - a, 1)]
        last = len(self.keys) - 1
        left = self.table[level, np.minimum(a, last)]
        right = self.table[level, np.clip(b - (1 << level.astype(np.int64)), 0, last)]
        return np.where(self.impact[right] > self.impact[left], right, left)

    def top(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int = 1, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best documents with a score of at least ``floor``, best first, then by place.

        With ``rounds`` the search ends early; what it then yields are scores of documents, but not surely the best."""
        floor = max(floor, 1)
        scores, docs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        a, b = np.searchsorted(self.keys, terms * self.n), np.searchsorted(self.keys, (terms + 1) * self.n)
        has = b > a
        terms, times, a, b = terms[has], times[has], a[has], b[has]
        if not len(terms):
            return scores, docs
        step = max(1, min(MOST, CELLS // len(terms)))

        def opened(lo, hi, a, b):
            best = self.largest(a, b)
            value = np.where(a < b, self.impact[best] * times, 0)
            bound = value.sum(axis=1)
            split = self.places[best[np.arange(len(lo)), value.argmax(axis=1)]]
            good = bound >= floor
            return bound[good], lo[good], hi[good], split[good], a[good], b[good]

        front = opened(np.zeros(1, dtype=np.int64), np.full(1, self.n), a[None, :], b[None, :])
        while len(front[0]) and (rounds is None or rounds > 0):
            rounds = None if rounds is None else rounds - 1
            bound, lo = front[0], front[1]
            if len(scores) == k:
                live = (bound > scores[-1]) | (bound == scores[-1]) & (lo < docs[-1])
                if not live.any():
                    break
                front = tuple(x[live] for x in front)
                bound, lo = front[0], front[1]
            take = np.zeros(len(bound), dtype=bool)
            take[np.lexsort((lo, -bound))[:step]] = True
            _, lo, hi, split, a, b = (x[take] for x in front)
            key = terms * self.n + split[:, None]
            at = np.searchsorted(self.keys, key)
            there = (at < b) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)
            score = np.where(there, self.impact[np.minimum(at, len(self.keys) - 1)] * times, 0).sum(axis=1)
            good = score >= floor
            scores, docs = np.concatenate((scores, score[good])), np.concatenate((docs, split[good]))
            best = np.lexsort((docs, -scores))[:k]
            scores, docs = scores[best], docs[best]
            lows, highs = np.concatenate((lo, split + 1)), np.concatenate((split, hi))
            firsts, lasts = np.concatenate((a, np.where(there, at + 1, at))), np.concatenate((at, b))
            some = lows < highs
            parts = opened(lows[some], highs[some], firsts[some], lasts[some])
            front = tuple(np.concatenate((x[~take], y)) for x, y in zip(front, parts))
        return scores, docs


def blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, norm) -> Iterator[Block]:
    """Blocks of a task's rows; small ones are put together."""
    run, n_docs, n_postings = [], 0, 0
    for batch in batches:
        for k in range(batch.num_rows):
            row = [batch.column(c)[k].values for c in range(6)]
            if run and (n_docs + len(row[0]) > BLOCK_DOCS or n_postings + len(row[4]) > BLOCK_POSTINGS):
                yield together(run, weights, norm)
                run, n_docs, n_postings = [], 0, 0
            run.append(row)
            n_docs += len(row[0])
            n_postings += len(row[4])
    if run:
        yield together(run, weights, norm)


def together(run: list, weights: np.ndarray, norm) -> Block:
    starts = np.cumsum([0] + [len(r[0]) for r in run])
    terms = np.concatenate([np.repeat(r[2].to_numpy(), r[3].to_numpy()) for r in run])
    places = np.concatenate([r[4].to_numpy() + s for r, s in zip(run, starts)])
    return Block([i for r in run for i in r[0].to_pylist()], np.concatenate([r[1].to_numpy() for r in run]), terms, places,
                 np.concatenate([r[5].to_numpy() for r in run]), weights, norm)


# -- all blocks


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def sizes_to_norm(n_docs: int, n_words: int):
    """m = 100 - 75 + (75 n N) div L, in 64 bits where they do and whole numbers of any size where not."""
    def norm(sizes: np.ndarray) -> np.ndarray:
        if len(sizes) and 75 * int(sizes.max()) * n_docs >= 2 ** 63:
            return np.array([25 + 75 * int(n) * n_docs // n_words for n in sizes], dtype=np.int64)
        return 25 + 75 * sizes * n_docs // n_words
    return norm


def passed(rows: DataFrame, queries, weights: np.ndarray, norm, k: int, floors, rounds: int | None) -> DataFrame:
    """Every block's best documents for every query, with at least the query's floor."""
    given = rows.sparkSession.sparkContext.broadcast((queries, weights, floors))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, floors = given.value
        for block in blocks(batches, weights, norm):
            out = ([], [], [])
            for q, (terms, times) in enumerate(queries):
                scores, docs = block.top(terms, times, k, floors[q], rounds)
                out[0].extend([q] * len(scores))
                out[1].extend(block.ids[d] for d in docs.tolist())
                out[2].extend(scores.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return rows.mapInArrow(find, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", group_chars: int = GROUP_CHARS) -> DataFrame:
    """item_col, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("body"))
    chars = asked.agg(F.sum(F.length("body"))).first()[0] or 0
    groups = max(1, math.ceil(chars / group_chars))
    out = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item", "body"), F.lit(groups)) == g).collect()
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], f"query int, item {asked.schema['item'].dataType.simpleString()}")
        counted = [Counter(terms_of(r["body"])) for r in rows]
        found = rank_group(docs, counted, k, id_col, text_col)
        now = found.join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "rank", "doc_id", "score")
        out = now if out is None else out.union(now)
    return out


def rank_group(docs: DataFrame, counted: list[Counter], k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary = sorted(set(chain.from_iterable(counted)))
    place = {w: p for p, w in enumerate(vocabulary)}
    rows = settle(index(docs, id_col, text_col, vocabulary))
    total = rows.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, n_words = total[0] or 0, total[1] or 1
    pairs = F.arrays_zip(F.col("terms").alias("t"), F.col("counts").alias("n"))
    df = {r[0]: r[1] for r in rows.select(F.explode(pairs).alias("p")).groupBy("p.t").agg(F.sum("p.n")).collect()}
    weights = np.array([weight(n_docs, df.get(p, 0)) for p in range(len(vocabulary))], dtype=np.int64)
    queries = []
    for c in counted:
        some = sorted((place[w], n) for w, n in c.items())
        queries.append((np.array([p for p, _ in some], dtype=np.int64), np.array([n for _, n in some], dtype=np.int64)))
    norm = sizes_to_norm(n_docs, n_words)
    probe = best(passed(rows, queries, weights, norm, k, [1] * len(queries), PROBE_ROUNDS), k)
    reached = {r[0]: r[1] for r in probe.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k).select("query", "s").collect()}
    floors = [reached.get(q, 1) for q in range(len(queries))]
    return best(passed(rows, queries, weights, norm, k, floors, None), k)


SEARCH_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
docs AS (SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nw FROM docs),
posts AS (SELECT rid, w, count(*) AS tf FROM (SELECT rid, unnest(ws) AS w FROM docs) GROUP BY rid, w),
asked AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY item_id, w),
weighed AS (SELECT w, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS weight
    FROM (SELECT w, count(*) AS df FROM posts GROUP BY w), totals),
scored AS (SELECT item_id, docs.rid, any_value(docs.doc_id) AS doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nw)))) AS BIGINT) AS score
    FROM asked JOIN weighed USING (w) JOIN posts USING (w) JOIN docs USING (rid), totals GROUP BY item_id, docs.rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scored WHERE score > 0) WHERE rank <= 10
"""
