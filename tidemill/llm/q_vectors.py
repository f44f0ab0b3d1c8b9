"""Queries over embeddings."""

from __future__ import annotations

from tidemill.llm.registry import query, table
from tidemill.llm.subspace import near_vectors


@query("op2_embedding_near_dedup")
def embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
