"""Language identification with string kernels.

Texts are compared by the blended-spectrum presence kernel: the number of distinct letter n-grams
(n = 1, 2, 3) two texts share, divided by the root of the product of their own numbers. Nyström: a few
labelled texts are landmarks, and a text's kernel values with them, times the inverse root of the
landmarks' own kernel matrix, are its features. One-versus-rest ridge regression on these features is
kernel ridge regression in that subspace. Only the n-grams of the landmarks are kept, each with the landmarks that have it.

Text is lower-cased; everything that is not a letter is a blank, and blanks run together. An n-gram's code
is made of its code points, 21 bits each, so no two letters of any script are taken for one another.

The model is fitted on a bounded sample: for each of at most ``MAX_LANGS`` languages ``per_lang`` different texts of at
most ``max_chars`` characters, chosen by the hash of the text, and fewer a language where there are many, so that no
more than ``MAX_TEXTS`` are gathered. A language that has only longer texts is learned from their first ``max_chars``
characters. Every text is scored, and whole.

The scores of a text add up to 1 whatever it is, so they compare languages and do not say whether the text is in any of
them. That is said by its likeness: the share of its n-grams, repeats included, that a language's landmarks have, divided by the median
share of the language's learning texts (of a landmark: by the other landmarks), for the language where this is largest.
A language with a single text, or with texts that share nothing, has no such median and takes the lowest of the others.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text where
nothing could be learned; with one language learned, every other text is that; repeated rows are judged
one by one; ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.batches import lists
from tidemill.llm.pieces import gather

POINT_BITS, BLANK = 21, 0x110000  # fixed values: bits of a code point, and the number after the last one
UND = "und"
MAX_LANGS = 2_000
PER_LANG = 300
MAX_CHARS = 20_000
MAX_TEXTS = 6_000
LANDMARKS = 96
BLOCK = 256


@dataclass
class LanguageModel:
    langs: list[str]
    letters: str  # of the learning texts
    grams: np.ndarray  # codes of the landmarks' n-grams, sorted
    starts: np.ndarray  # where a gram's landmarks begin in ``owners``
    owners: np.ndarray
    norms: np.ndarray
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    mark_langs: np.ndarray  # language of each landmark, ascending
    speakers: np.ndarray  # languages of each n-gram, every one once
    speaker_starts: np.ndarray
    levels: np.ndarray  # median share of known n-grams, by language; 0 where nothing tells it


@lru_cache(maxsize=4)
def _symbols(letters: str) -> np.ndarray:
    """Symbol of each code point: itself where it is a letter here or was one where the model learned, else the blank."""
    table = np.fromiter((c if chr(c).isalpha() else BLANK for c in range(0x110000)), dtype=np.int64, count=0x110000)
    for c in letters:
        table[ord(c)] = ord(c)
    return table


class Spectrum:
    """Distinct n-grams of texts, as sorted codes. No symbol is zero, so grams of different length have different codes."""

    def __init__(self, letters: str):
        self.table = _symbols(letters)

    def codes(self, text: str) -> np.ndarray:
        return np.unique(self.all_codes(text))

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how often each occurs."""
        return np.unique(self.all_codes(text), return_counts=True)

    def all_codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = np.concatenate(([BLANK], self.table[points], [BLANK]))
        s = s[np.concatenate(([True], (s[1:] != BLANK) | (s[:-1] != BLANK)))]
        two = s[:-1] << POINT_BITS | s[1:]
        return np.concatenate((s[s != BLANK], two, two[:-1] << POINT_BITS | s[2:]))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def labelled_sample(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang",
                    per_lang: int = PER_LANG, max_chars: int = MAX_CHARS, max_texts: int = MAX_TEXTS) -> DataFrame:
    """Different texts of every language, those with the smallest hash. A first cut by hash alone keeps the sort small."""
    usable = learn & F.col(lang_col).isNotNull() & F.rlike(text_col, F.lit(r"\p{L}"))
    key = F.md5(F.concat(F.lit("lang|"), text_col))
    short = F.length(text_col) <= max_chars
    # a text counts once, however many rows have it
    kinds = docs.where(usable).select(F.col(lang_col).alias("l"), short.alias("short"), key.alias("key")).distinct().groupBy("l", "short").count()
    n: dict[str, tuple[bool, int]] = {}
    for r in kinds.take(2 * MAX_LANGS + 1):
        if r["l"] not in n or r["short"]:
            n[r["l"]] = (r["short"], r["count"])
    if len(n) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the model has a column for each")
    if not n:
        return docs.sparkSession.createDataFrame([], "lang string, text string, n int")
    each = max(2, min(per_lang, max_texts // len(n)))
    # 2 * each + 50 texts are expected below the rate, so fewer than each (or than there are) do not happen
    plan = F.create_map(*[x for lang, (is_short, c) in sorted(n.items()) for x in (
        F.lit(lang), F.struct(F.lit(is_short).alias("short"), F.lit((2.0 * each + 50) / c).alias("rate")))])
    mine = F.element_at(plan, F.col(lang_col))
    draw = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    near = docs.where(usable & (short == mine["short"]) & (draw < mine["rate"])) \
        .select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, max_chars).alias("text"), key.alias("key"))
    once = near.groupBy("lang", "key").agg(F.first("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("key")
    return once.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("lang", "text", "n")


def fit(sample: DataFrame, landmarks: int = LANDMARKS, ridge: float = 0.1) -> LanguageModel | None:
    rows = sorted((r["lang"], r["n"], r["text"]) for r in sample.collect())
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    letters = "".join(sorted({c for _, _, text in rows for c in text.lower() if c.isalpha()}))
    each = max(2, landmarks // len(langs))
    marks = [r for r in rows if r[1] <= each]
    spectrum = Spectrum(letters)
    sets = [spectrum.codes(r[2]) for r in marks]
    codes, owners = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(codes, kind="stable")
    grams, first = np.unique(codes[order], return_index=True)
    mark_langs = np.array([langs.index(r[0]) for r in marks])
    of_gram, speakers = np.divmod(np.unique(np.repeat(np.arange(len(grams)), np.diff(np.append(first, len(codes)))) * len(langs) + mark_langs[owners[order]]), len(langs))
    model = LanguageModel(langs, letters, grams, np.append(first, len(codes)), owners[order], np.sqrt(np.array([len(s) for s in sets], dtype=np.float64)),
                          np.zeros((len(sets), len(langs))), np.zeros(len(langs)), mark_langs, speakers,
                          np.searchsorted(of_gram, np.arange(len(grams) + 1)), np.zeros(len(langs)))
    model.levels = levels(model, spectrum, rows, each)
    own = np.stack([shared(model, places(model, s)[0]) for s in sets]) / np.outer(model.norms, model.norms)
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel(model, spectrum, [r[2] for r in rows]) @ root
    answers = np.where(np.array([r[0] for r in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    # every language counts the same, however few texts it has
    sizes = {lang: sum(r[0] == lang for r in rows) for lang in langs}
    share = np.array([len(rows) / len(langs) / sizes[r[0]] for r in rows])[:, None]
    mean, level = (features * share).mean(axis=0), (answers * share).mean(axis=0)
    inner = features - mean
    beta = np.linalg.solve((inner * share).T @ inner + ridge * np.eye(inner.shape[1]), (inner * share).T @ (answers - level))
    model.weights = root @ beta
    model.bias = level - mean @ beta
    return model


def levels(model: LanguageModel, spectrum: Spectrum, rows: list[tuple[str, int, str]], each: int) -> np.ndarray:
    """Median share of a learning text's n-grams that landmarks of its language other than itself have."""
    marks = len(model.norms)
    held = np.repeat(np.arange(len(model.grams)), np.diff(model.starts)) * marks + model.owners  # ascending
    shares: dict[str, list[float]] = {lang: [] for lang in model.langs}
    for lang, n, text in rows:
        low, high = np.searchsorted(model.mark_langs, (model.langs.index(lang), model.langs.index(lang) + 1))
        own = int(n <= each)
        if high - low > own:
            codes, counts = spectrum.counts(text)
            at, known = places(model, codes)
            holders = np.searchsorted(held, at * marks + high) - np.searchsorted(held, at * marks + low)
            shares[lang].append(counts[known][holders > own].sum() / counts.sum())
    found = {lang: float(np.median(some)) for lang, some in shares.items() if some and np.median(some) > 0}
    return np.array([found.get(lang, min(found.values(), default=0.0)) for lang in model.langs])


def places(model: LanguageModel, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams that the model knows, and which of the given ones these are."""
    at = np.searchsorted(model.grams, codes)
    known = model.grams[np.minimum(at, len(model.grams) - 1)] == codes
    return at[known], known


def shared(model: LanguageModel, at: np.ndarray) -> np.ndarray:
    """Number of n-grams that each landmark shares with the text whose known n-grams are at these places."""
    starts = model.starts[at]
    return np.bincount(gather(model.owners, starts, model.starts[at + 1] - starts), minlength=len(model.norms))


def likeness(model: LanguageModel, at: np.ndarray, counts: np.ndarray, n: int) -> float:
    """How far a text is in one of the languages; about 1 if it is. Its known n-grams are at these places, and occur so
    often; all its n-grams together are ``n``.

    Where no language's level is known nothing speaks against a text, and it is 1."""
    starts = model.speaker_starts[at]
    sizes = model.speaker_starts[at + 1] - starts
    known = np.bincount(gather(model.speakers, starts, sizes), weights=np.repeat(counts, sizes), minlength=len(model.langs))
    told = model.levels > 0
    return float((known[told] / n / model.levels[told]).max()) if told.any() else 1.0


def kernel(model: LanguageModel, spectrum: Spectrum, texts: list[str], like: list[float] | None = None) -> np.ndarray:
    """Kernel values of texts with the landmarks. The texts' likenesses are added to ``like``."""
    out = np.empty((len(texts), len(model.norms)))
    for k, text in enumerate(texts):
        codes, counts = (spectrum.codes(text), None) if like is None else spectrum.counts(text)
        at, known = places(model, codes)
        out[k] = shared(model, at) / np.sqrt(max(len(codes), 1)) / model.norms
        if like is not None:
            like.append(likeness(model, at, counts[known], max(int(counts.sum()), 1)))
    return out


def predict(model: LanguageModel, spectrum: Spectrum, texts: list[str | None], like: list[float] | None = None) -> tuple[list[str], list[float]]:
    """Languages and scores. The likenesses of the texts that have a letter, 0 for the others, are added to ``like``."""
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if has_letter(t)]
    found: list[float] | None = None if like is None else []
    if known:
        margin = kernel(model, spectrum, [texts[k] for k in known], found) @ model.weights + model.bias
        best = margin.argmax(axis=1)
        value = np.round(np.clip((margin[np.arange(len(known)), best] + 1) / 2, 0, 1), 6)
        for k, b, v in zip(known, best, value):
            langs[k], scores[k] = model.langs[b], float(v)
    if like is not None:
        by_row = dict(zip(known, found))
        like.extend(by_row.get(k, 0.0) for k in range(len(texts)))
    return langs, scores


def classifier(spark, model: LanguageModel | None, with_likeness: bool = False):
    """A function from a text column to a struct of lang and score, and likeness where asked for."""
    if model is None:
        return lambda text: F.struct(F.lit(UND).alias("lang"), F.lit(0.0).alias("score"), *[F.lit(0.0).alias("likeness")] * with_likeness)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double" + ", likeness double" * with_likeness)
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spectrum = Spectrum(shared.value.letters)
        for texts in lists(batches, BLOCK):
            like = [] if with_likeness else None
            langs, scores = predict(shared.value, spectrum, texts, like)
            columns = {"lang": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            if with_likeness:
                columns["likeness"] = pa.array(like, pa.float64())
            yield pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    return classify.asNondeterministic()


def identify(docs: DataFrame, learn: Column):
    """Fits on the rows where ``learn`` holds; returns the function to apply to a text column."""
    return classifier(docs.sparkSession, fit(labelled_sample(docs, learn)))
