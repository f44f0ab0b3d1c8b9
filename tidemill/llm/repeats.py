"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to maximal exact repeats.

A window is ``width`` consecutive words. Blocks of half a window, cut without overlap from each document,
are the index; any window then holds one whole block of the document that it starts in. Every rolling
half-window of every document probes the index, and a probe is a hit where the block's smallest document
is below its own. A hit is extended to all windows around it: those of the prober and those of the block's
owner. Equal windows meet again by an 80-bit hash of their words, and a window is repeated where one of
them starts in a document with a smaller id; neighbouring repeated windows make up the maximal repeat.

All hashes are polynomials over 64-bit word hashes, so every window of a batch comes from one running
sum. Probes travel as packed arrays, about five bytes a word, in parts whose number follows the text, so
that a part stays small at any size; the index of a part is in memory while its probes stream by.
A document that no probe hit is never looked at again. Windows that are decided within a task's own batch
of documents do not travel, so a passage that a third of all documents share arrives once a batch.

Defined cases: a null text has no words; a null id is neither smaller nor greater than another, so such a
document keeps all; documents with one id are judged one by one, and not against each other; fewer words
than a window: all kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.batches import batch, rows

WIDTH = 50
BATCH_WORDS = 131_072
PART_CHARS = 24_000_000
MEMO_WORDS = 150_000
U64 = np.uint64
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)  # odd, so that powers can be divided out
MIX = U64(0xD6E8FEB86659FD93)
PROBES = pa.schema([("part", pa.int64()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("ids", "tags", "ends", "at", "marks")])
HITS = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32())])
BODIES = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("body", pa.binary())])
FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("wide", pa.bool_()), ("starts", pa.binary())])
WINDOWS = pa.schema([("part", pa.int64()), *FOUND, ("high", pa.binary()), ("low", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
SLICES = 8


class Memo(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.full(n, b, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values; one for each start."""
    if len(words) < width:
        return np.empty(0, dtype=U64)
    up, down = powers(base, len(words))
    run = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(words * up, dtype=U64)))
    mixed = (run[width:] - run[:-width]) * down[:len(words) - width + 1]
    mixed = (mixed ^ (mixed >> U64(32))) * MIX
    return mixed ^ (mixed >> U64(29))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(parts) >> U64(32)).astype(np.uint16 if parts < 65_536 else np.uint32)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def tag_of(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def packed(at: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype(np.uint32).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint32), dtype=np.int64)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def runs(docs: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Lists of (…, words) rows with a bounded number of words; one document is never cut."""
    run, size = [], 0
    for row in docs:
        run.append(row)
        size += len(row[-1])
        if size >= BATCH_WORDS:
            yield run
            run, size = [], 0
    if run:
        yield run


def probe(parts: int, width: int):
    """Documents to packed index blocks (kind 0) and probes (kind 1)."""
    half = width // 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        docs = ((i, tag_of(t), words_of(t)) for i, t in rows(batches, ["doc_id", "text"]))
        for run in runs(d for d in docs if len(d[2]) >= width):
            ids, tags = np.array([d[0] for d in run], dtype=np.int64), np.array([d[1] for d in run], dtype=np.int64)
            sizes = np.array([len(d[2]) for d in run], dtype=np.int64)
            ends = np.cumsum(sizes)
            marks = rolling(memo.hashes([w for d in run for w in d[2]]), half, BASES[0])
            within = np.arange(len(marks)) - np.repeat(ends - sizes, sizes)[:len(marks)]
            whole = within <= np.repeat(sizes - half, sizes)[:len(marks)]
            compress = zstandard.ZstdCompressor(level=1).compress
            head = (compress(ids.tobytes()), tags.tobytes(), compress(ends.tobytes()))
            for kind, places in ((0, np.flatnonzero(whole & (within % half == 0))), (1, np.flatnonzero(whole))):
                mine = marks[places]
                owner = part_of(mine, parts)
                order = np.argsort(owner, kind="stable")
                cuts = np.searchsorted(owner[order], np.arange(parts + 1))
                out = [(p, kind, *head, packed(places[order[a:b]]), mine[order[a:b]].astype(np.uint32).tobytes())
                       for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
                yield batch(PROBES, out)

    return pack


def read_probes(ids: bytes, ends: bytes, at: bytes, marks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marks of a packed row and their places, and the row's ids and ends of documents."""
    undo = zstandard.ZstdDecompressor().decompress
    return np.frombuffer(marks, dtype=np.uint32), unpacked(at), np.frombuffer(undo(ids), dtype=np.int64), np.frombuffer(undo(ends), dtype=np.int64)


def place(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which document a flat place is in, and where in it."""
    doc = np.searchsorted(ends, flat, side="right")
    return doc, flat - np.where(doc > 0, ends[doc - 1], 0)


def hit_batch(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tags), pa.array(pos.astype(np.int32))], schema=HITS)


class Index:
    """Blocks of one part: for each mark the smallest document that has it, and where."""

    def __init__(self):
        self.found: list[tuple[np.ndarray, ...]] = []
        self.ready = False

    def add(self, ids: bytes, tags: bytes, ends: bytes, at: bytes, marks: bytes) -> None:
        mark, flat, doc_ids, stops = read_probes(ids, ends, at, marks)
        doc, pos = place(flat, stops)
        self.found.append((mark, doc_ids[doc], np.frombuffer(tags, dtype=np.int64)[doc], pos))

    def close(self) -> None:
        self.ready = True
        marks, ids, tags, pos = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.empty(0, dtype=np.int64),) * 4
        order = np.lexsort((ids, marks))
        marks, ids, tags, pos = marks[order], ids[order], tags[order], pos[order]
        new = np.concatenate((np.ones(min(1, len(marks)), dtype=bool), marks[1:] != marks[:-1]))
        self.marks, self.ids = marks[new], ids[new]
        self.touched = np.zeros(len(self.marks), dtype=bool)
        # a document may have its own block in several places; each of them starts other windows
        slot = np.cumsum(new) - 1
        mine = ids == self.ids[slot]
        self.owned = slot[mine], ids[mine], tags[mine], pos[mine]
        self.found = []

    def hits(self, ids: bytes, tags: bytes, ends: bytes, at: bytes, marks: bytes) -> pa.RecordBatch | None:
        if not len(self.marks):
            return None
        mark, flat, doc_ids, stops = read_probes(ids, ends, at, marks)
        slot = np.minimum(np.searchsorted(self.marks, mark), len(self.marks) - 1)
        same = np.flatnonzero(self.marks[slot] == mark)
        doc, pos = place(flat[same], stops)
        above = doc_ids[doc] > self.ids[slot[same]]
        if not above.any():
            return None
        self.touched[slot[same[above]]] = True
        return hit_batch(doc_ids[doc[above]], np.frombuffer(tags, dtype=np.int64)[doc[above]], pos[above])

    def owners(self) -> pa.RecordBatch:
        slot, ids, tags, pos = self.owned
        hit = self.touched[slot]
        return hit_batch(ids[hit], tags[hit], pos[hit])


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and kind to hits: doc_id, tag, pos of half-windows to extend."""
    at_part, index = None, Index()
    for part, kind, *packed_row in rows(batches, PROBES.names, 20):
        if part != at_part:
            if index.ready:
                yield index.owners()
            at_part, index = part, Index()
        if kind == 0:
            index.add(*packed_row)
            continue
        if not index.ready:
            index.close()
        found = index.hits(*packed_row)
        if found is not None:
            yield found
    if index.ready:
        yield index.owners()


def extend(parts: int, width: int):
    """Documents with hits to the hashes of all windows around them; what the batch itself decides is ``sure``."""
    half = width // 2

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, undo = Memo(), zstandard.ZstdDecompressor().decompress
        docs = ((i, t, p, undo(z).split()) for i, t, p, z in rows(batches, ["doc_id", "tag", "pos", "body"]))
        for run in runs(docs):
            key, starts, high, low = [], [], [], []
            for n, (_, _, hits, words) in enumerate(run):
                hashes = memo.hashes(words)
                last = len(words) - width
                change = np.zeros(len(words) + 2, dtype=np.int64)
                pos = np.asarray(hits, dtype=np.int64)
                np.add.at(change, np.maximum(pos - (width - half), 0), 1)
                np.add.at(change, np.minimum(pos, last) + 1, -1)
                at = np.flatnonzero(np.cumsum(change)[:last + 1] > 0)
                key.append(np.full(len(at), n))
                starts.append(at)
                high.append(rolling(hashes, width, BASES[0])[at])
                low.append((rolling(hashes, width, BASES[1])[at] >> U64(48)).astype(np.uint16))
            key, starts, high, low = map(np.concatenate, (key, starts, high, low))
            repeated = smaller_exists(high, low, np.array([d[0] for d in run], dtype=np.int64)[key])
            # a window seen in a smaller document of the batch is settled, with no hash to meet others by
            part = np.where(repeated, -1, part_of(high, parts).astype(np.int64))
            order = np.lexsort((part, key))
            k, p = key[order], part[order]
            cuts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]), [True]))) if len(k) else np.zeros(1, dtype=int)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                o, (doc_id, tag, _, words) = order[a:b], run[k[a]]
                wide = len(words) >= 65_536
                at = starts[o].astype(np.uint32 if wide else np.uint16).tobytes()
                settled = p[a] < 0
                out.append((tag % parts if settled else p[a], doc_id, tag, wide, at, None if settled else high[o].tobytes(), None if settled else low[o].tobytes()))
            yield batch(WINDOWS, out)

    return widen


def smaller_exists(high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which entries share their hash with an entry of a smaller id."""
    order = np.lexsort((ids, low, high))
    out = np.zeros(len(high), dtype=bool)
    if len(order):
        a, b, doc = high[order], low[order], ids[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        out[order] = doc > doc[new][np.cumsum(new) - 1]
    return out


def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after the other, and where each begins and ends; nulls are empty."""
    parts = [np.frombuffer(v.as_buffer(), dtype=kind) if v.is_valid else np.empty(0, dtype=kind) for chunk in column.chunks for v in chunk]
    return np.concatenate(parts) if parts else np.empty(0, dtype=kind), np.cumsum([0] + [len(x) for x in parts])


def decide(table: pa.Table) -> pa.Table:
    """All windows of one part to the repeated ones: doc_id, tag, wide, starts. Hashes are compared a slice at a time."""
    high, bounds = joined(table["high"], U64)
    low, _ = joined(table["low"], np.uint16)
    ids = table["doc_id"].to_numpy()
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(bounds))
    repeated = np.zeros(len(high), dtype=bool)
    for k in range(SLICES):
        at = np.flatnonzero(high % U64(SLICES) == U64(k))
        repeated[at] = smaller_exists(high[at], low[at], ids[owner[at]])
    out, settled = [], table["high"].is_null().to_pylist()
    for n, (doc_id, tag, wide, starts) in enumerate(zip(*(table[c].to_pylist() for c in FOUND.names))):
        if settled[n]:
            out.append((doc_id, tag, wide, starts))
        elif (hit := repeated[bounds[n]:bounds[n + 1]]).any():
            out.append((doc_id, tag, wide, np.frombuffer(starts, dtype=np.uint32 if wide else np.uint16)[hit].tobytes()))
    return pa.Table.from_batches([batch(FOUND, out)])


def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        for a in range(0, b.num_rows, 1_000):
            found = rows([b.slice(a, 1_000)], ["doc_id", "text"])
            yield batch(BODIES, [(i, tag_of(t), compress((t or "").encode("utf-8", "surrogatepass"))) for i, t in found])


def cut_out(width: int):
    """Documents and their repeated windows to doc_id, n_words, n_removed and the digest of the kept words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for doc_id, z, found in rows([b], ["doc_id", "body", "starts"]):
                words = undo(z).split()
                kept, gone = words, 0
                if found is not None:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    starts = np.frombuffer(b"".join(found), dtype=np.uint32 if len(words) >= 65_536 else np.uint16).astype(np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + width, -1)
                    stays = np.cumsum(change)[:-1] == 0
                    kept = [w for w, s in zip(words, stays.tolist()) if s]
                    gone = len(words) - len(kept)
                out.append((doc_id, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield batch(KEPT, out)

    return cut


def keep_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that take no part. One function, so that a task needs one Python worker."""
    for b in batches:
        split = ((i, words_of(t)) for i, t in rows([b], ["doc_id", "text"]))
        yield batch(KEPT, [(i, len(w), 0, hashlib.sha256(b" ".join(w)).hexdigest()) for i, w in split])


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """bodies (doc_id, tag, body) and, for those with repeats, doc_id, tag, starts (packed starts of repeated windows)."""
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts, wide_parts = max(cores, ceil(chars / PART_CHARS)), max(cores, ceil(chars / PART_CHARS / 4))
    probes = texts.mapInArrow(probe(parts, width), ddl(PROBES))
    hits = probes.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(match, ddl(HITS))
    around = hits.groupBy("doc_id", "tag").agg(F.collect_list("pos").alias("pos"))
    # the filter is what an inner join adds anyway: with it, both joins see the same plan and share one shuffle
    bodies = texts.mapInArrow(body, ddl(BODIES)).where(F.col("doc_id").isNotNull() & F.col("tag").isNotNull())
    windows = bodies.join(around, ["doc_id", "tag"]).select("doc_id", "tag", "pos", "body").mapInArrow(extend(wide_parts, width), ddl(WINDOWS))
    found = windows.groupBy("part").applyInArrow(decide, ddl(FOUND))
    return bodies, found.groupBy("doc_id", "tag").agg(F.collect_list("starts").alias("starts"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row a document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bodies, found = repeated_windows(texts, width)
    judged = bodies.join(found, ["doc_id", "tag"], "left").select("doc_id", "body", "starts").mapInArrow(cut_out(width), ddl(KEPT))
    nameless = texts.where(F.col("doc_id").isNull()).mapInArrow(keep_all, ddl(KEPT))
    return judged.union(nameless)
