"""Byte-level BPE encoding and decoding with a transducer of frequent words.

The texts' words (pre-tokens) are counted over all documents. Those that make up at least a ``share`` of all
words, so at most ``1 / share`` of them, are compiled into a minimal acyclic transducer: words share their
first and their last bytes, and the outputs along a word's path add up to its rank, which names its ids.
The transducer is one file of 32-bit numbers in the shared folder; every executor fetches it with
``addFile``, and workers map it into memory. Words are looked up side by side, a byte of all of them at a
time. Words it does not have are merged by the tokenizer's own model, once each while the memo lasts.

A text is cut into words by classes of code points, which are asked of the tokenizer's own splitter, so
both agree on every character. Added tokens are cut out first, as the tokenizer does.

Defined cases: a null or empty text has no tokens; texts are never cut short (those of over ``CUT``
characters are worked on in pieces that end before white space, where a word always begins); repeated rows
are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.batches import lists
from tidemill.llm.pieces import gather, parts
from tidemill.session import ensure_checkpoint_dir, settle

LETTER, NUMBER, SPACE, OTHER = range(4)
POINTS = 0x110000
SHORT, LONG = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")  # fixed values: endings that are words after an apostrophe
SHARE = 1 / 200_000
MAX_BYTES = 64  # longer words are merged, never compiled
COUNTED = 300_000
MEMO_WORDS = 150_000
CUT = 1_000_000
MAGIC = 0x54524E31
WORDS_A_TEXT = 500
WRITE = 4 << 20
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean, ids array<int>"
NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "lossless", "ids"]


def load_tokenizer(raw: str):
    """The tokenizer and its added tokens; refuses files whose words are not cut as this module cuts them."""
    from tokenizers import Tokenizer

    spec = json.loads(raw)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
        raise ValueError("only byte-level BPE without a normaliser or a prefix blank")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in their surroundings are not supported")
    tokenizer = Tokenizer.from_str(raw)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, {t["content"]: t["id"] for t in spec["added_tokens"]}


def token_bytes(tokenizer, added: dict[str, int]) -> list[bytes]:
    """Bytes of every id. The byte alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.encode() if token in added and not all(c in back for c in token) else bytes(back[c] for c in token)
    return out


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """Class of every code point as the tokenizers library has it: what its own expressions leave of all code points."""
    from tokenizers import Regex, normalizers

    points = [chr(c) for c in range(POINTS) if not 0xD800 <= c < 0xE000]
    found = np.full(POINTS, OTHER, dtype=np.uint8)
    for kind, other in ((LETTER, r"\P{L}+"), (NUMBER, r"\P{N}+"), (SPACE, r"\S+")):
        kept = normalizers.Replace(Regex(other), "")
        for a in range(0, len(points), 50_000):
            left = kept.normalize_str("".join(points[a:a + 50_000]))
            found[np.frombuffer(left.encode("utf-32-le"), dtype=np.uint32)] = kind
    return found


class Splitter:
    """Cuts texts into words."""

    def __init__(self, classes: np.ndarray, added: dict[str, int]):
        self.classes = classes
        self.added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.names = tuple(added)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Pieces that can be cut into words one by one, and whether a piece is an added token."""
        if any(t in text for t in self.names):
            pieces = [(p, k % 2 == 1) for k, p in enumerate(self.added.split(text)) if p]
        else:
            pieces = [(text, False)] if text else []
        if len(text) <= CUT:
            return pieces
        return [(part, token) for p, token in pieces for part in ([p] if token else self.cut(p))]

    def cut(self, text: str) -> Iterator[str]:
        """Long texts, cut before a run of white space."""
        a = 0
        while len(text) - a > CUT:
            b = a + CUT
            while b < len(text):
                kinds = self.classes[np.frombuffer(text[b - 1:b + CUT].encode("utf-32-le"), dtype=np.uint32)] == SPACE
                heads = np.flatnonzero(kinds[1:] & ~kinds[:-1])
                if len(heads):
                    b += int(heads[0])
                    break
                b = min(b + CUT, len(text))
            yield text[a:b]
            a = b
        if a < len(text):
            yield text[a:]

    def words(self, pieces: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, where each word begins in them (and the end), and how many words a piece has."""
        joined = "".join(p for p, _ in pieces)
        p = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        n = len(p)
        ends = np.cumsum(np.fromiter((len(t) for t, _ in pieces), dtype=np.int64, count=len(pieces)))
        begins = ends - np.diff(np.concatenate(([0], ends)))
        first = np.zeros(n + 4, dtype=bool)
        first[begins] = True
        first[n:] = True
        kind = np.full(n + 1, SPACE, dtype=np.uint8)
        kind[:n] = self.classes[p]
        space = kind == SPACE
        start = first[:n].copy()
        joins = ~space[1:n] & (p[:-1] == 0x20)  # a blank belongs to the word that follows
        start[1:] |= (kind[1:n] != kind[:n - 1]) & ~joins
        start |= space[:n] & ~space[1:n + 1] & ~first[1:n + 1]  # the last white space before a word stands by itself
        marks = np.flatnonzero((p == 0x27) & start)
        if len(marks):
            near = np.concatenate((p, np.zeros(3, dtype=np.uint32)))
            one, two = near[marks + 1], near[marks + 2]
            short = np.isin(one, [c[0] for c in SHORT]) & ~first[marks + 1]
            long = np.zeros(len(marks), dtype=bool)
            for pair in LONG:
                long |= (one == pair[0]) & (two == pair[1])
            long &= ~first[marks + 1] & ~first[marks + 2]
            start = np.concatenate((start, np.ones(4, dtype=bool)))
            start[marks[short | long] + 1] = False
            start[marks[long] + 2] = False
            start[marks[short] + 2] = True
            start[marks[long] + 3] = True
            start = start[:n]
        for k, (_, token) in enumerate(pieces):
            if token:
                start[begins[k] + 1:ends[k]] = False
        heads = np.flatnonzero(start)
        width = np.concatenate(([0], np.cumsum(1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000))))
        return (np.frombuffer(joined.encode(), dtype=np.uint8), width[np.append(heads, n)],
                np.diff(np.concatenate(([0], np.searchsorted(heads, ends)))))


# -- frequent words


def count_words(docs: DataFrame, column: str, splitter: Splitter) -> DataFrame:
    """word, n over all texts; words of over MAX_BYTES bytes are counted as the empty word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return made

        for part in parts(t for batch in batches for some in lists([batch.column(0)]) for t in some):
            pieces = [(p, False) for t in part for p, token in splitter.segments(t) if not token]
            for some in _bounded(pieces):
                buf, at, _ = splitter.words(some)
                raw, at = buf.tobytes(), at.tolist()
                found.update(raw[a:b] if b - a <= MAX_BYTES else b"" for a, b in zip(at, at[1:]))
                if len(found) >= COUNTED:
                    yield out()
        yield out()

    return docs.select(column).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bounded(pieces: list[tuple[str, bool]]) -> Iterator[list[tuple[str, bool]]]:
    """Runs of pieces of about CUT characters."""
    run, size = [], 0
    for piece in pieces:
        run.append(piece)
        size += len(piece[0])
        if size >= CUT:
            yield run
            run, size = [], 0
    if run:
        yield run


def frequent_words(counts: DataFrame, share: float = SHARE) -> list[bytes]:
    """Words with at least ``share`` of all words, in byte order: never more than 1 / share."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2, total * share)
    return sorted(bytes(r[0]) for r in counts.where((F.col("n") >= least) & (F.length("word") > 0)).select("word").collect())


# -- transducer


def compile_words(words: list[bytes]) -> tuple[list[tuple[bool, tuple]], int]:
    """Minimal acyclic automaton of sorted words: states (is a word's end, ((byte, state), ...)), those below first; the first state's place."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    path, labels = [[False, []]], []

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((labels.pop(), add(final, arcs)))

    def add(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    before = b""
    for word in words:
        common = len(os.path.commonprefix([before, word]))
        freeze(common)
        for byte in word[common:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0] = True
        before = word
    freeze(0)
    root = add(*path[0])
    return states, root


def pack(states: list[tuple], root: int, ids: list[list[int]], classes: np.ndarray) -> bytes:
    """The transducer as one block of numbers.

    A state's arcs lie at its base plus their byte, in slots shared with other states; ``owner`` says whose a slot is."""
    counts = np.zeros(len(states), dtype=np.int64)
    for k, (final, arcs) in enumerate(states):
        counts[k] = final + sum(counts[s] for _, s in arcs)
    size = sum(len(arcs) for _, arcs in states) + 1024
    free = np.ones(2 * size + 1024, dtype=bool)
    base, owner, target, output = np.zeros(len(states), dtype=np.int32), *(np.full(len(free), v, dtype=np.int32) for v in (-1, 0, 0))
    order = sorted((k for k in range(len(states)) if states[k][1]), key=lambda k: -len(states[k][1]))
    low = 0
    for k in order:
        final, arcs = states[k]
        offsets = np.array([b for b, _ in arcs])
        if len(arcs) == 1:  # the rest in order: any free slot will do
            while not free[256 + low]:
                low += 1
            at = 256 + low - offsets[0]
        else:
            lo = low
            while True:
                bases = lo + np.arange(512)
                fits = free[256 + bases[:, None] - offsets[0] + offsets].all(axis=1)
                if fits.any():
                    at = 256 + lo + int(fits.argmax()) - offsets[0]
                    break
                lo += 512
            while not free[256 + low]:
                low += 1
        base[k] = at
        slots = at + offsets
        free[slots] = False
        owner[slots] = k
        target[slots] = [s for _, s in arcs]
        output[slots] = final + np.cumsum([0] + [counts[s] for _, s in arcs[:-1]])
    used = (int(np.flatnonzero(~free).max()) if (~free).any() else 0) + 257
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
    starts = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    final = np.array([f for f, _ in states], dtype=np.int32)
    head = np.array([MAGIC, len(states), used, len(ids), len(flat), root], dtype=np.int32)
    return b"".join(x.tobytes() for x in (head, base, final, owner[:used], target[:used], output[:used], starts, flat, classes))


class Lexicon:
    """A transducer file, mapped into memory."""

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, dtype=np.int32, mode="r"))
        magic, n_states, n_slots, n_words, n_ids, self.root = data[:6].tolist()
        if magic != MAGIC:
            raise ValueError(f"not a lexicon: {path}")
        cuts = np.cumsum([6, n_states, n_states, n_slots, n_slots, n_slots, n_words + 1, n_ids])
        self.base, self.final, self.owner, self.target, self.output, self.starts, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:]))
        self.classes = np.asarray(data[cuts[-1]:]).view(np.uint8)

    def ranks(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of each word buf[at[k]:at[k + 1]], -1 for those the lexicon has not."""
        found = np.full(len(at) - 1, -1, dtype=np.int32)
        live = np.flatnonzero(np.diff(at) <= MAX_BYTES).astype(np.int32)
        pos, left = at[live], np.diff(at)[live].astype(np.int32)
        state, rank = np.full(len(live), self.root, dtype=np.int32), np.zeros(len(live), dtype=np.int32)
        while len(live):
            slot = self.base[state] + buf[pos]
            ok = self.owner[slot] == state
            live, pos, left, slot, rank = live[ok], pos[ok] + 1, left[ok] - 1, slot[ok], rank[ok]
            state = self.target[slot]
            rank = rank + self.output[slot]
            done = left == 0
            if done.any():
                whole = done & (self.final[state] == 1)
                found[live[whole]] = rank[whole]
                go = ~done
                live, pos, left, state, rank = live[go], pos[go], left[go], state[go], rank[go]
        return found


# -- encoding


@dataclass(frozen=True)
class Built:
    """What an encoder needs: names of the files that the session hands to executors."""

    model: str
    lexicon: str


class Codec:
    """Tokenizer and lexicon in one Python worker."""

    def __init__(self, raw: str, path: str):
        self.tokenizer, self.added = load_tokenizer(raw)
        self.lexicon = Lexicon(path)
        self.splitter = Splitter(self.lexicon.classes, self.added)
        pieces = token_bytes(self.tokenizer, self.added)
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.piece_sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.digits = [str(k) for k in range(len(pieces))]
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids, self.starts = array("i"), array("q", [0])
        for token, i in self.added.items():
            self.keep([token.encode()], [i], [1])

    def keep(self, words: list[bytes], ids, sizes) -> None:
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words))))
        self.starts.extend((len(self.ids) + np.cumsum(sizes, dtype=np.int64)).tolist())
        self.ids.extend(ids)

    def merge(self, words: list[bytes]) -> None:
        """Ids of words the lexicon has not, by the tokenizer's merges.

        Words that begin with a blank and are no white space go there joined, as they are cut again at their blanks;
        their tokens are told apart by their bytes."""
        shown = [w.decode() for w in words]
        joined = [t[0] == " " and len(t) > 1 and self.splitter.classes[ord(t[1])] != SPACE for t in shown]
        some = [w for w, j in zip(words, joined) if j]
        lots = [some[a:a + WORDS_A_TEXT] for a in range(0, len(some), WORDS_A_TEXT)] + [[w] for w, j in zip(words, joined) if not j]
        for a in range(0, len(lots), WORDS_A_TEXT):
            now, single = lots[a:a + WORDS_A_TEXT], []
            for lot, e in zip(now, self.tokenizer.encode_batch_fast([b"".join(lot).decode() for lot in now], add_special_tokens=False)):
                ids = e.ids
                if len(lot) == 1:
                    single.append((lot[0], ids))
                    continue
                ends = np.cumsum(self.piece_sizes[ids])
                cuts = np.searchsorted(ends, np.cumsum([len(w) for w in lot]), side="right")
                self.keep(lot, ids, np.diff(cuts, prepend=0))
            self.keep([w for w, _ in single], chain.from_iterable(ids for _, ids in single), [len(ids) for _, ids in single])

    def encode(self, pieces: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each piece."""
        if not pieces:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        buf, at, per_piece = self.splitter.words(pieces)
        ranks = self.lexicon.ranks(buf, at)
        missed = np.flatnonzero(ranks < 0)
        raw = buf.tobytes()
        words = [raw[a:b] for a, b in zip(at[missed].tolist(), at[missed + 1].tolist())]
        new = set(words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.forget()
            new = set(words).difference(self.memo)
        self.merge(list(new))
        known = ranks >= 0
        lex = self.lexicon
        place = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        starts = np.array(self.starts, dtype=np.int64)
        sizes = np.empty(len(ranks), dtype=np.int64)
        sizes[known] = lex.starts[ranks[known] + 1] - lex.starts[ranks[known]]
        sizes[missed] = starts[place + 1] - starts[place]
        ids = np.empty(int(sizes.sum()), dtype=np.int32)
        from_lexicon = np.repeat(known, sizes)
        ids[from_lexicon] = gather(lex.ids, lex.starts[ranks[known]].astype(np.int64), sizes[known])
        ids[~from_lexicon] = gather(np.array(self.ids, dtype=np.int32), starts[place], sizes[missed])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(bounds[np.concatenate(([0], np.cumsum(per_piece)))])

    def texts(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each text."""
        cut = [self.splitter.segments(t) for t in some]
        done = [self.encode(run) for run in _bounded([p for pieces in cut for p in pieces])]
        sizes = np.concatenate([s for _, s in done] or [np.zeros(0, dtype=np.int64)])
        ids = np.concatenate([i for i, _ in done] or [np.zeros(0, dtype=np.int32)])
        ends = np.cumsum([len(pieces) for pieces in cut])
        return ids, np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(sizes)))[ends])))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: its tokens' bytes, broken ones replaced."""
        lengths = self.piece_sizes[ids]
        joined = gather(self.piece_bytes, self.piece_starts[ids], lengths).tobytes()
        at = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [joined[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:])]


@lru_cache(maxsize=2)
def _codec(built: Built) -> Codec:
    with open(SparkFiles.get(built.model), encoding="utf-8") as f:
        return Codec(f.read(), SparkFiles.get(built.lexicon))


def put_file(spark, name: str, data: bytes) -> str:
    """Write bytes into the shared folder by its own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/tidemill/{name}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    for a in range(0, len(data), WRITE):
        out.write(bytearray(data[a:a + WRITE]))
    out.close()
    return place.toString()


def build(docs: DataFrame, model_path: str, column: str = "text", share: float = SHARE) -> Built:
    """Count words, compile the frequent ones and hand tokenizer and transducer to the executors."""
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:
        tokenizer, added = load_tokenizer(f.read())
    classes = point_classes()
    words = frequent_words(settle(count_words(docs, column, Splitter(classes, added))), share)
    ids = [e.ids for a in range(0, len(words), 10_000)
           for e in tokenizer.encode_batch_fast([w.decode() for w in words[a:a + 10_000]], add_special_tokens=False)]
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(put_file(spark, name, pack(*compile_words(words), ids, classes)))
    spark.sparkContext.addFile(model_path)
    return Built(os.path.basename(model_path), name)


def encoder(built: Built, keep_ids: bool = False):
    """A function from a text column to a struct of n_tokens, ids_sha256, decoded_sha256, lossless and, if asked, ids."""
    @F.arrow_udf(SCHEMA)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(built)
        for batch in batches:
            for part in parts(t for some in lists([batch]) for t in some):
                ids, sizes = codec.texts(part)
                decoded = codec.decode(ids, sizes)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                shown = list(map(codec.digits.__getitem__, ids.tolist()))
                lots = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)) if keep_ids \
                    else pa.nulls(len(part), pa.list_(pa.int32()))
                yield pa.StructArray.from_arrays([
                    pa.array(sizes), pa.array([hashlib.sha256(",".join(shown[a:b]).encode()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                    pa.array([d == t.encode() for d, t in zip(decoded, part)]), lots], names=NAMES)

    return encode.asNondeterministic()
