"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

No SQL says what the stages do (trained models, rotations of bits, a tokenizer); the pipeline is tested
against a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.stages import encode_pieces, keep_known_languages, keep_one_of_near_copies, mask_personal_data, mix_sources
from tidemill.session import settle

STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("personal_data", mask_personal_data),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
