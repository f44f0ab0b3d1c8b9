"""Queries of the operators that work on texts in Python tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.llm.bilinear import score
from tidemill.llm.crf import finder
from tidemill.llm.langid import identify
from tidemill.llm.pieces import encoder
from tidemill.llm.registry import query, table
from tidemill.llm.repeats import remove_repeats
from tidemill.llm.sliced import near_duplicates

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def id_hash(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


@query("op1_sentencepiece")
def sentencepiece(spark, sf_dir, model_path: str = TOKENIZER):
    """doc_id, n_tokens, ids, decoded_sha256, lossless (decoded text is the text), parity (ids equal the other library's)."""
    encode = encoder(spark, model_path)
    done = table(spark, sf_dir, "documents").select("doc_id", encode("text").alias("e"))
    return done.select("doc_id", "e.n_tokens", "e.ids", "e.decoded_sha256", "e.lossless", "e.parity")


@query("op9_language_id")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = id_hash(3) == 1
    classify = identify(docs, ~held)
    return docs.select("doc_id", held.alias("held_out"), classify("text").alias("p")) \
        .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


@query("op3_lm_scoring")
def lm_scoring(spark, sf_dir):
    found = score(table(spark, sf_dir, "documents"), id_hash(7) != 2)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_substring_dedup")
def substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_personal_data")
def personal_data(spark, sf_dir):
    find = finder(spark, mask=False)
    return table(spark, sf_dir, "documents").select("doc_id", find("text").alias("p")) \
        .select("doc_id", "p.n_email", "p.n_ip", "p.n_card", "p.n_phone", "p.base_sha256", "p.spans")
