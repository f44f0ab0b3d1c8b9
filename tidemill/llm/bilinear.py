"""Language-model scoring with a log-bilinear neural model, trained by noise-contrastive estimation.

The model predicts the class of the next token from the classes of the two before it: the sum of their
two context vectors times the token class's target vector, plus its bias. The ``VOCABULARY`` most frequent
tokens are classes of their own, every other token belongs to one of ``BUCKETS`` classes by its ending, and
within such a class it has its smoothed share of the corpus counts. That makes a proper distribution over
all texts, with the same allowance for unseen tokens as the unigram base score.

Training goes over all learning documents: every task runs noise-contrastive estimation in numpy over its
own part, from a common start, and the parameters are averaged by tokens. The normalisers of all pairs of
context classes are then computed by batched matrix products, so every token log-probability is normalised.

Counts are exact, over the whole corpus. The tokens that make up at least one ``HEAD``-th of it, of which
there are ``HEAD`` at most, are broadcast; all others meet their counts in a join in which no key is hot.

Tokens are the words of the text with A-Z lower-cased, then one end token.

Defined cases: a null or empty text is the end token alone; with nothing to learn from, all counts are
zero and the base score is that of its formula; rows are scored one by one, also where ids repeat; a null
id is hashed like the empty text.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import settle

VOCABULARY = 512
BUCKETS = 256
DIM = 16
HEAD = 1_000_000
NOISE = 32
BATCH = 1_024
WORDS_AT_ONCE = 262_144
MEMO_WORDS = 300_000
COUNTED = 200_000
RATE = 0.1
END = b"\n"
SEED = 42


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def document_batches(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
    """Rows and their tokens, a bounded number of tokens at a time; one text is never cut."""
    rows, texts, size = [], [], 0
    for f in frames:
        for *row, text in zip(*(f[c] for c in [*columns, "text"])):
            rows.append(tuple(row))
            texts.append(tokens(text))
            size += len(texts[-1]) + 1
            if size >= WORDS_AT_ONCE:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def count_tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"tok": list(seen.keys()), "c": np.fromiter(seen.values(), dtype=np.int64, count=len(seen))})

    for _, texts in document_batches(frames, []):
        for words in texts:
            seen.update(words)
        seen[END] += len(texts)
        if len(seen) > COUNTED:
            yield out()
            seen.clear()
    yield out()


@dataclass
class Vocabulary:
    top: list[bytes]  # own classes, the end token first
    head: bytes  # frequent tokens, an Arrow table of tok and c
    norms: np.ndarray  # log10 of each class's share normaliser, 0 for own classes
    prior: np.ndarray  # smoothed class probabilities
    n: int
    v: int

    @property
    def classes(self) -> int:
        return len(self.norms)


class Coder(dict):
    """Tokens to slots; each slot has a class and log10(c + 1), or -1 where the count is not in the head."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.own = {w: k for k, w in enumerate(words.top)}
        table = pa.ipc.open_stream(words.head).read_all()
        self.known = dict(zip(table["tok"].to_pylist(), np.log10(table["c"].to_numpy() + 1.0).tolist()))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.classes, self.logs, self.words = array("i"), array("d"), []

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self.classes)
        own = self.own.get(word)
        self.classes.append(len(self.own) + bucket(word) if own is None else own)
        self.logs.append(self.known.get(word, -1.0))
        self.words.append(word)
        return slot

    def code(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > MEMO_WORDS:
            self.forget()
        slots = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return slots, np.array(self.classes, dtype=np.int32)[slots], np.array(self.logs)[slots]


def bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-3:], SEED) & (BUCKETS - 1)


def flat(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All tokens with an end after each text, and where each text starts."""
    words: list[bytes] = []
    for t in texts:
        words += t
        words.append(END)
    return words, np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]


def contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places before; before a text there are ends (class 0)."""
    one = np.concatenate((np.zeros(1, dtype=np.int32), classes[:-1]))
    two = np.concatenate((np.zeros(2, dtype=np.int32), classes[:-2]))[:len(classes)]
    one[starts] = 0
    two[starts] = 0
    return one, two


class Bilinear:
    """Rows of ``table``: first context, second context and target vectors, then the bias, of each class."""

    def __init__(self, prior: np.ndarray, table: np.ndarray | None = None):
        self.prior = prior.astype(np.float32)
        if table is None:
            rng = np.random.default_rng(SEED)
            table = np.concatenate([rng.standard_normal((len(prior), 3 * DIM)) * 0.1, np.log(prior)[:, None]], axis=1)
        self.table = table.astype(np.float32)
        self.past = np.full_like(self.table, 0.01)
        self.rng = np.random.default_rng(SEED)
        self.cumulative = np.cumsum(prior)

    def views(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = self.table
        return t[:, :DIM], t[:, DIM:2 * DIM], t[:, 2 * DIM:3 * DIM], t[:, 3 * DIM]

    def step(self, column: slice, rows: np.ndarray, grads: np.ndarray) -> None:
        """Adagrad on some rows; gradients of equal rows are added up first."""
        order = np.argsort(rows, kind="stable")
        where = np.flatnonzero(np.concatenate(([True], rows[order][1:] != rows[order][:-1])))
        total, which = np.add.reduceat(grads[order], where, axis=0), rows[order][where]
        past = self.past[which, column] + total * total
        self.past[which, column] = past
        self.table[which, column] += RATE * total / np.sqrt(past)

    def learn(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        """One minibatch: each target against ``NOISE`` noise classes, which the minibatch shares."""
        first, second, q, bias = self.views()
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), len(self.prior) - 1)
        p = first[one] + second[two]
        own = q[target]
        shift = np.log(NOISE * self.prior)
        right = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", p, own) + bias[target] - shift[target], -30, 30)))
        wrong = 1 / (1 + np.exp(-np.clip(p @ q[noise].T + (bias - shift)[noise], -30, 30)))
        up = ((1 - right) / len(target)).astype(np.float32)
        down = (wrong / len(target)).astype(np.float32)
        dp = up[:, None] * own - down @ q[noise]
        dq = np.concatenate((up[:, None] * p, -(down.T @ p)))
        db = np.concatenate((up, -down.sum(axis=0)))
        scale = np.float32(len(target))  # Adagrad divides the step by its size; keep sums, not means, as its memory
        self.step(slice(0, DIM), one, dp * scale)
        self.step(slice(DIM, 2 * DIM), two, dp * scale)
        self.step(slice(2 * DIM, 3 * DIM + 1), np.concatenate((target, noise)), np.column_stack((dq, db)) * scale)

    def normalisers(self, one: int) -> np.ndarray:
        """Natural log normaliser of every second context class after ``one``."""
        first, second, q, bias = self.views()
        s = (first[one][None, :] + second) @ q.T + bias
        top = s.max(axis=1)
        return top + np.log(np.exp(s - top[:, None]).sum(axis=1))

    def log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, z: np.ndarray) -> np.ndarray:
        first, second, q, bias = self.views()
        out = np.empty(len(target))
        for a in range(0, len(target), 65_536):
            s = slice(a, a + 65_536)
            out[s] = np.einsum("ij,ij->i", first[one[s]] + second[two[s]], q[target[s]]) + bias[target[s]] - z[one[s], two[s]]
        return out / np.log(10)


def corpus_counts(learning: DataFrame) -> DataFrame:
    """tok, c over all learning documents."""
    return settle(learning.select("text").mapInPandas(count_tokens, "tok binary, c long").groupBy("tok").agg(F.sum("c").alias("c")))


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    first = counts.where(F.col("tok") != END).orderBy(F.desc("c"), "tok").limit(VOCABULARY - 1).collect()
    top = [END, *(bytes(r["tok"]) for r in first)]
    frequent = counts.where((F.col("c") * HEAD >= n) | F.col("tok").isin(top)).toArrow() if n else pa.table({"tok": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frequent.schema) as w:
        w.write_table(frequent)
    mark = F.xxhash64(F.when(F.length("tok") > 3, F.substring("tok", -3, 3)).otherwise(F.col("tok"))).bitwiseAND(F.lit(BUCKETS - 1))
    inside = counts.where(~F.col("tok").isin(top)).groupBy(mark.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    shares = {r["b"]: (r["n"], r["v"]) for r in inside.collect()}
    end = counts.where(F.col("tok") == END).first()
    own = [end["c"] if end else 0, *(r["c"] for r in first)]
    rest = [shares.get(b, (0, 0)) for b in range(BUCKETS)]
    prior = np.array(own + [r[0] for r in rest], dtype=np.float64) + 1
    norms = np.concatenate((np.zeros(len(top)), np.log10([a + b + 1.0 for a, b in rest])))
    return Vocabulary(top, sink.getvalue().to_pybytes(), norms, prior / prior.sum(), int(n), int(v))


def train(learning: DataFrame, words: Vocabulary) -> Bilinear:
    shared = learning.sparkSession.sparkContext.broadcast(words)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, model, seen = Coder(shared.value), Bilinear(shared.value.prior), 0
        for _, texts in document_batches(frames, []):
            all_words, starts = flat(texts)
            _, classes, _ = coder.code(all_words)
            one, two = contexts(classes, starts)
            mixed = model.rng.permutation(len(classes))
            for a in range(0, len(mixed), BATCH):
                some = mixed[a:a + BATCH]
                model.learn(one[some], two[some], classes[some])
            seen += len(classes)
        if seen:
            yield pd.DataFrame({"class": np.arange(len(model.table)), "seen": seen, "row": list(model.table.astype(np.float64))})

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        mean = np.average(np.stack(rows["row"].to_list()), axis=0, weights=rows["seen"].to_numpy(dtype=np.float64))
        return pd.DataFrame({"class": rows["class"].iloc[:1], "row": [mean]})

    parts = learning.select("text").mapInPandas(run, "class int, seen long, row array<double>")
    rows = parts.groupBy("class").applyInPandas(average, "class int, row array<double>").collect()
    table = np.stack([r["row"] for r in sorted(rows, key=lambda r: r["class"])]) if rows else None
    return Bilinear(words.prior, table)


def all_normalisers(spark, model: Bilinear) -> np.ndarray:
    """Classes x classes, one row a task's matrix product."""
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"one": f["id"], "z": [shared.value.normalisers(int(k)).astype(np.float64) for k in f["id"]]})

    rows = spark.range(len(model.table)).mapInPandas(run, "one long, z array<double>").collect()
    return np.stack([r["z"] for r in sorted(rows, key=lambda r: r["one"])]).astype(np.float32)


SCORED = "row long, doc_id string, learned int, tok binary, tf long, n long, head double, score double, known long"


def score_texts(docs: DataFrame, words: Vocabulary, model: Bilinear, z: np.ndarray) -> DataFrame:
    """For each row of docs (row, doc_id, learned, text): one row with what its task knows, and one for each token outside the head."""
    shared = docs.sparkSession.sparkContext.broadcast((words, model, z))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, model, z = shared.value
        coder = Coder(words)
        for rows, texts in document_batches(frames, ["row", "doc_id", "learned"]):
            all_words, starts = flat(texts)
            slots, classes, logs = coder.code(all_words)
            one, two = contexts(classes, starts)
            rare = logs < 0
            outside = classes >= len(words.top)
            given = np.where(rare, 0.0, logs)
            score = model.log10(one, two, classes, z) - words.norms[classes] + np.where(outside, given, 0.0)
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
            yield pd.DataFrame({"row": ids, "doc_id": [r[1] for r in rows], "learned": [r[2] for r in rows], "tok": [END + b"%d" % i for i in ids.tolist()], "tf": 0, "n": sizes,
                                "head": np.add.reduceat(given, starts), "score": np.add.reduceat(score, starts),
                                "known": np.add.reduceat((~rare).astype(np.int64), starts)})
            if rare.any():
                place = np.repeat(np.arange(len(rows), dtype=np.int64), sizes)[rare]
                pairs, tf = np.unique(place << 32 | slots[rare], return_counts=True)
                toks = [coder.words[k] for k in (pairs & 0xFFFFFFFF).tolist()]
                yield pd.DataFrame({"row": ids[pairs >> 32], "doc_id": None, "learned": 0, "tok": toks, "tf": tf, "n": 0, "head": 0.0, "score": 0.0, "known": 0})

    return docs.mapInPandas(run, SCORED)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score; one row a document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    learning = rows.where("learned")
    counts = corpus_counts(learning)
    words = vocabulary(counts)
    model = train(learning, words)
    z = all_normalisers(docs.sparkSession, model)
    numbered = rows.select("text", F.col("doc_id").cast("string").alias("doc_id"), F.col("learned").cast("int").alias("learned"),
                           F.monotonically_increasing_id().alias("row"))
    scored = score_texts(numbered, words, model, z).withColumn("doc_id", F.col("doc_id").cast("long"))
    rare = counts.where((F.col("c") * HEAD < words.n) & ~F.col("tok").isin(words.top))
    c = F.coalesce("c", F.lit(0))
    sums = scored.join(rare, "tok", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("learned").alias("learned"), F.sum("n").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum("head").alias("head"), F.sum("score").alias("model"), F.sum(F.col("tf") * F.log10(c + 1)).alias("tail"))
    total = float(np.log10(words.n + words.v + 1))
    return sums.select("doc_id", (F.col("learned") == 1).alias("learned"), "n_tokens", "n_known", F.lit(words.n).cast("long").alias("train_tokens"),
                       (F.col("head") + F.col("tail") - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("model") + F.col("tail")).alias("score"))
