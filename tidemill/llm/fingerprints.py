"""Document fingerprints: SimHash with weighted term votes, and search by permuted block tables (DataFrame functions only).

Terms are neighbouring word pairs of the lower-cased text (a lone word is its own term); a term's weight
is how often it occurs. Each term's 64-bit hash votes with its weight for or against every bit. The 64
sums are kept in 32 longs, two 32-bit counters in each, so one pass of ordinary sums collects all votes.

``with_next`` gives every row the text of the next document in descending id order. Rows are cut into id
ranges at quantiles of the id and ordered within a range; the first text of each range goes to the range
before it. No range is larger than the data over ``MAX_RANGES``, and texts are shuffled once.

``near_counts`` finds, for query fingerprints, all within a Hamming radius: two such agree on one of the
block tables' masks, equal fingerprints are one entry with a weight, and a pair counts in the first table
where it meets. A fingerprint has at most sum(C(64, i), i <= radius) different neighbours, so no query's
list grows without bound.

Defined cases: a null or blank text has no terms and fingerprint zero; a null text is edited like an empty
one; null ids come last; rows with one id follow each other by text, the greater first; a single document
is its own next; equal texts have equal fingerprints.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.mixing import BLANK_RUN, BLANKS
from tidemill.llm.sliced import choose_blocks, tables
from tidemill.session import settle

LANES = 32
PAIR = (1 << 32) + 1
MAX_RANGES = 10_000
RANGE_CHARS = 4_000_000


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def terms(text: Column) -> Column:
    inner = F.btrim(F.lower(text), F.lit(BLANKS))
    words = F.split(inner, BLANK_RUN)
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1)))
    # the last word has no partner; it stands alone only where it is the only word
    pairs = F.when(F.size(words) > 1, F.slice(F.arrays_zip(words.alias("a"), after.alias("b")), F.lit(1), F.size(words) - 1)) \
        .otherwise(F.arrays_zip(words.alias("a"), words.alias("b")))
    return F.when(inner != "", pairs)


def votes(hash_: Column) -> list[Column]:
    lanes = [F.sum(F.shiftrightunsigned(hash_, k).bitwiseAND(F.lit(PAIR))).alias(f"v{k}") for k in range(LANES)]
    return [*lanes, F.count(hash_).alias("n_terms")]


def decided() -> Column:
    """The fingerprint from the collected votes: a bit is set where more than half of the weight votes for it."""
    out = F.lit(0).cast("long")
    for k in range(LANES):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{k}"), 32)
        out = out.bitwiseOR(F.when(2 * low > F.col("n_terms"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        out = out.bitwiseOR(F.when(2 * high > F.col("n_terms"), F.lit(signed(1 << (k + 32)))).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, fp; rows with equal keys count as one text."""
    exploded = rows.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("t"))
    return exploded.select(*keys, F.when(F.col("t").isNotNull(), F.xxhash64("t.a", "t.b")).alias("h")) \
        .groupBy(*keys).agg(*votes(F.col("h"))).select(*keys, decided().alias("fp"))


def ranged(docs: DataFrame, id_col: str, size: Column) -> DataFrame:
    """Adds ``rng``: the id's range, higher for higher ids, -1 for null ids."""
    key = F.col(id_col).cast("double")
    total = docs.agg(F.sum(size)).first()[0] or 0
    ranges = min(MAX_RANGES, ceil(total / RANGE_CHARS))
    if ranges < 2:
        return docs.withColumn("rng", F.when(F.col(id_col).isNull(), -1).otherwise(0))
    probe = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(docs.select(key.alias("k")).na.drop().approxQuantile("k", probe, 0.25 / ranges)))
    if not cuts:
        return docs.withColumn("rng", F.lit(-1))
    cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_id", outputCol="_rng", handleInvalid="keep")
    cut = cutter.transform(docs.withColumn("_id", key))
    return cut.withColumn("rng", F.when(F.col("_id").isNull(), -1).otherwise(F.col("_rng").cast("int"))).drop("_id", "_rng")


def following(firsts: DataFrame, value: str) -> DataFrame:
    """rng, after: for each range the first value of the next lower one, for the last the first of all. One row a range."""
    down = Window.orderBy(F.col("rng").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return firsts.select("rng", F.coalesce(F.lead(value).over(down), F.first(value).over(whole)).alias("after"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rng, nth, doc_id, text, next_text."""
    base = ranged(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", F.length("text"))
    heads = base.groupBy("rng").agg(F.max("doc_id").alias("head"))
    first = base.join(heads.withColumnRenamed("rng", "r"), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("rng") == F.col("r"))) \
        .groupBy("rng").agg(F.max("text").alias("first_text"))
    down = Window.partitionBy("rng").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    placed = base.withColumn("nth", F.row_number().over(down)).withColumn("lead_text", F.lead("text").over(down))
    after = settle(following(first, "first_text"))
    return placed.join(after, "rng").select("rng", "nth", "doc_id", "text", F.coalesce("lead_text", "after").alias("next_text"))


def edit(text: Column, next_text: Column) -> Column:
    """The last third of the code points replaced by as many from the start of the next text."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """fp, n_near: rows of ``prints`` (fp) within the radius of each distinct query fp, itself included."""
    entries = settle(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("weight")))
    masks = [F.lit(signed(m)) for m in tables(blocks or choose_blocks(entries.count(), radius), radius)]
    filed = lambda df, *cols: df.select(*cols, F.posexplode(F.array(*[F.col("fp").bitwiseAND(m) for m in masks])).alias("tab", "val"))
    left = filed(entries, F.col("fp").alias("other"), "weight", "fp").drop("fp")
    right = filed(queries.select("fp").distinct(), "fp")
    met = left.alias("l").join(right.alias("r"), (F.col("l.tab") == F.col("r.tab")) & (F.col("l.val") == F.col("r.val")))
    apart = F.col("l.other").bitwiseXOR(F.col("r.fp"))
    first = F.lit(True)
    for n, m in enumerate(masks[:-1]):
        first = first & ((F.col("l.tab") <= n) | (apart.bitwiseAND(m) != 0))
    return met.where((F.bit_count(apart) <= radius) & first).groupBy(F.col("r.fp").alias("fp")).agg(F.sum("l.weight").alias("n_near"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next."""
    edited = with_next(docs, id_col, text_col).select("rng", "nth", "doc_id", "text", edit(F.col("text"), F.col("next_text")).alias("edited"))
    both = edited.select("rng", "nth", "doc_id", F.length("text").cast("long").alias("n_chars"),
                         F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("body")) for k, c in enumerate(["text", "edited"])])).alias("s"))
    keys = ["rng", "nth", "doc_id", "n_chars", "edited_sha256"]
    signs = fingerprints(both.select(*keys, "s.side", "s.body"), [*keys, "side"], "body")
    rows = settle(signs.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"),
                                           F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp")))
    order = Window.partitionBy("rng").orderBy("nth")
    after = following(rows.where("nth = 1").select("rng", F.col("fp").alias("first_fp")), "first_fp")
    ahead = rows.withColumn("lead_fp", F.lead("fp").over(order)).join(after, "rng").withColumn("next_fp", F.coalesce("lead_fp", "after"))
    return ahead.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
