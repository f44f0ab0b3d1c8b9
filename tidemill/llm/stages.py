"""The operators as stages of a corpus pipeline: documents in, documents out.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All columns of the input stay
as they are unless the stage's decision changes them, whatever their names: rows travel as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.crf import finder
from tidemill.llm.langid import UND, classifier, fit, labelled_sample
from tidemill.llm.mixing import mix, repeat_rows
from tidemill.llm.pieces import encoder
from tidemill.llm.sliced import fingerprint, near_duplicates
from tidemill.session import settle

LEAST_SHARE = 0.8
SHINGLE, RADIUS = 4, 4  # those of the operator's own query
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, least_share: float = LEAST_SHARE) -> DataFrame:
    """Documents without a letter, and those that look like no learned language, go.

    A text is in a language if its n-grams are known there nearly as often as those of the language's own texts: its
    likeness, as ``langid`` defines it, is ``least_share`` or more. The score cannot tell: the best of n scores that add
    up to 1 is never below 1 / n. The model learns from labelled rows; where there are none, nothing is judged but the letters."""
    model = fit(labelled_sample(docs, F.lit(True)))
    if model is None:
        return docs.where(F.rlike(F.col("text"), F.lit(r"\p{L}")))
    judged = docs.select(whole_row(docs), classifier(spark, model, with_likeness=True)("text").alias("p"))
    return judged.where((F.col("p.lang") != UND) & (F.col("p.likeness") >= least_share)).select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (nulls last); of equal ids the smallest text."""
    found = near_duplicates(docs, width=width, radius=radius)
    # component_id is the group's smallest id, null where all its ids are: the rows with it are few, and one a group stays
    keepers = settle(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("root", "component_id", F.col("fp").alias("keep_fp")).distinct())
    signed = docs.select(whole_row(docs), F.col("doc_id").alias("id"), F.col("text").alias("body"), fingerprint(width)("text").alias("fp"))
    kept = signed.join(keepers, (F.col("fp") == F.col("keep_fp")) & F.col("id").eqNullSafe(F.col("component_id")))
    return kept.groupBy("root").agg(F.min_by("row", F.struct(F.col("body").isNotNull(), "body")).alias("row")).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind; n_chars follows the text where it changed."""
    done = docs.select(whole_row(docs), finder(spark)("text").alias("p"))
    changed = F.col("p.spans") != ""
    new = {"text": F.when(changed, F.col("p.masked")).otherwise(F.col("row.text")),
           "n_chars": F.when(changed, F.length("p.masked").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return repeat_rows(mix(docs, docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = TOKENIZER) -> DataFrame:
    """Adds token_ids, n_tokens, lossless and parity; columns of these names are replaced."""
    done = docs.select(whole_row(docs), encoder(spark, model_path)("text").alias("e"))
    added = {"token_ids": "e.ids", "n_tokens": "e.n_tokens", "lossless": "e.lossless", "parity": "e.parity"}
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *[F.col(c).alias(n) for n, c in added.items()])
