"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf (only the fields used here), and normaliser, word marker, scores
and byte fallback are rebuilt as a ``tokenizers`` pipeline: a unigram model keeps its scores, a BPE
model gets its merges from them (every split of a piece into two known pieces, in score order).

No piece of such a model holds a word marker after another character, so words with their leading
blanks can be encoded one by one (this is checked; a model with other pieces is encoded text by text).
Only words not seen before go to the tokenizer, in multithreaded batches; the memo of known words is
bounded: it starts anew before the run of texts that finds it full. Such a model takes a literal marker for
a blank, so texts are cut at both. The ``sentencepiece`` library encodes every text whole, and ``parity``
says whether its ids are the text's final ids.

Defined cases: a null or empty text has no tokens and is lossless; texts are never cut; repeated rows
are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import functions as F

from tidemill.llm.batches import lists

MARK = "▁"
MEMO_WORDS = 150_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the file format
UNIGRAM, BPE = 1, 2  # fixed values: model types of the file format
CHARS_AT_ONCE = 250_000
WORDS_A_TEXT = 500
WORDS = re.compile(r" *+[^ ]++(?: ++\Z)?+| ++")  # each begins with a blank, once a text has one before it
SCHEMA = "ids array<int>, n_tokens long, decoded_sha256 string, lossless boolean, parity boolean, decoded string"
NAMES = ["ids", "n_tokens", "decoded_sha256", "lossless", "parity", "decoded"]


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        width = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, buf[at:at + width]
        at += width


def parse_model(raw: bytes) -> Model:
    pieces, trainer, norm = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), unk, norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)))


def bpe_merges(model: Model) -> list[tuple[str, str]]:
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    found.append((-score, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model):
    """The tokenizers pipeline for a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unk = model.pieces[model.unk_id][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, bpe_merges(model), unk_token=unk, fuse_unk=True,
                          byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind}: only unigram and BPE models have scores to rebuild")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += ([normalizers.Prepend(MARK)] if model.dummy_prefix else []) + [normalizers.Replace(" ", MARK)]
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                    + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    user = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]
    if user:
        out.add_tokens(user)
    return out


def splits_at_words(model: Model) -> bool:
    """Whether words can be encoded alone: plain text in, and no piece goes on after a word's end."""
    inside = re.compile(f"[^{MARK}]{MARK}")
    return model.dummy_prefix and not model.squeeze and not model.charsmap and not any(
        kind == USER or inside.search(p) for p, _, kind in model.pieces)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[0]:][:sizes[0]], flat[starts[1]:][:sizes[1]], ... one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


class Codec:
    """One model in one Python worker. Token ids of a batch are one flat array and the texts' lengths in it."""

    def __init__(self, raw: bytes, threads: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.threads = threads
        self.model = parse_model(raw)
        self.tokenizer = build(self.model)
        self.check = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.words = WORDS if splits_at_words(self.model) else None
        if self.words is not None:
            self.tokenizer.normalizer = None  # it would only put markers for blanks, as learn does
        self.forget()
        self.heads = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        pieces = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode()
                  for p, _, kind in self.model.pieces]
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.piece_sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    def forget(self) -> None:
        self.memo = defaultdict(count().__next__)  # a word without its first blank, and its number
        self.ids, self.starts, self.sizes = array("i"), array("q"), array("q")

    def cut(self, text: str) -> list[str]:
        """A text's words, each without the blank it begins with."""
        text = text.replace(MARK, " ")
        if self.words is WORDS and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        return [word[1:] for word in self.words.findall(" " + text)] if text else []

    def learn(self, words: list[str]) -> None:
        """Encode new words, in the order of their numbers.

        Those without a further blank go to the tokenizer joined to texts, since each of them begins with the
        only pieces that begin with a marker.
        """
        order = None
        # that no word has a further blank, as nearly always, shows when they are joined; only otherwise they are looked at one by one
        if " " in "".join(words) or "" in words:
            order = sorted(range(len(words)), key=lambda k: not words[k] or " " in words[k])
            plain = sum(1 for w in words if w and " " not in w)
            words = [words[k] for k in order]
        else:
            plain = len(words)
        lots = [words[k:min(k + WORDS_A_TEXT, plain)] for k in range(0, plain, WORDS_A_TEXT)] + [[w] for w in words[plain:]]
        texts = [MARK + (MARK.join(lot) if len(lot) > 1 else lot[0].replace(" ", MARK)) for lot in lots]
        ours = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        at, starts, sizes = len(self.ids), [], []
        for lot, e in zip(lots, ours):
            ids = np.array(e.ids, dtype=np.int32)
            cuts = np.flatnonzero(self.heads[ids]) if len(lot) > 1 else np.zeros(1, dtype=np.int64)
            if len(cuts) != len(lot):
                raise AssertionError("words and their first pieces do not agree")
            self.ids.frombytes(ids.tobytes())
            starts.append(at + cuts)
            sizes.append(np.diff(cuts, append=len(ids)))
            at += len(ids)
        for mine, found in ((self.starts, starts), (self.sizes, sizes)):
            numbers = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            if order is not None:
                numbers[order] = numbers.copy()
            mine.frombytes(numbers.tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, each text's number of them, and whether the other library's ids are the same."""
        theirs = self.check.encode(texts, num_threads=self.threads, return_type="numpy")
        if self.words is None:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            same = [np.array_equal(a, b) for a, b in zip(found, theirs)]
            return np.array([i for ids in found for i in ids], dtype=np.int32), np.array([len(ids) for ids in found], dtype=np.int64), np.array(same)
        if len(self.memo) >= MEMO_WORDS or len(self.memo) != len(self.sizes):  # full, or learning was broken off
            self.forget()
        known, cut = len(self.memo), [self.cut(t) for t in texts]
        # a word asked for the first time gets the next number
        places = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        self.learn(list(islice(reversed(self.memo), len(self.memo) - known))[::-1])
        sizes = np.array(self.sizes, dtype=np.int64)[places]
        ids = gather(np.array(self.ids, dtype=np.int32), np.array(self.starts, dtype=np.int64)[places], sizes)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0] + [len(words) for words in cut])]
        same = [np.array_equal(ids[a:b], other) for a, b, other in zip(bounds[:-1], bounds[1:], theirs)]
        return ids, np.diff(bounds), np.array(same, dtype=bool)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Pieces joined and the marker's blank taken off; texts with broken bytes go to the library's own decoder."""
        lengths = self.piece_sizes[ids]
        joined = gather(self.piece_bytes, self.piece_starts[ids], lengths).tobytes()
        at = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        out = []
        for k, (s, e) in enumerate(zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist())):
            part = joined[s + 1:e] if self.model.dummy_prefix and joined[s:s + 1] == b" " and e > s else joined[s:e]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(ids[bounds[k]:bounds[k + 1]].tolist(), skip_special_tokens=False))
        return out


@lru_cache(maxsize=2)
def _codec(name: str, threads: int) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(f.read(), threads)


def encoder(spark, model_path: str, threads: int = 2, keep_text: bool = False):
    """A function from a text column to a struct of ids, n_tokens, decoded_sha256, lossless, parity, decoded.

    The model file is added to the session, so every executor gets it, also one that starts later."""
    spark.sparkContext.addFile(model_path)
    name = os.path.basename(model_path)

    @F.arrow_udf(SCHEMA)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(name, threads)
        for batch in batches:
            for part in parts(t for some in lists([batch]) for t in some):
                ids, sizes, same = codec.encode(part)
                decoded = codec.decode(ids, sizes)
                bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.StructArray.from_arrays([
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)), pa.array(sizes),
                    pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]),
                    pa.array(list(map(str.__eq__, decoded, part))), pa.array(same),
                    pa.array(decoded if keep_text else [None] * len(part), pa.string())], names=NAMES)

    return encode.asNondeterministic()


def parts(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Runs of texts with a bounded number of characters; one text is never cut."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= CHARS_AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run
