"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.llm.fingerprints import compare_edits, near_counts
from tidemill.llm.mixing import MIX_SQL, mix
from tidemill.llm.registry import query, table
from tidemill.llm.urls import URL_SQL, judge
from tidemill.session import settle


@query("op6_source_mixing", MIX_SQL)
def source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


@query("op10_url_filters", URL_SQL)
def url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), ["page_id"]).select("row.page_id", "host", "path", "rule", "verdict")


def hex16(col: str):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


@query("op7_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    """Also n_near: documents within 3 bits, itself excluded, for every id divisible by 20 (else null)."""
    rows = settle(compare_edits(table(spark, sf_dir, "documents")))
    asked = F.col("doc_id") % 20 == 0
    near = near_counts(rows.where(asked), rows.select("fp"))
    return rows.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next", F.when(asked, F.col("n_near") - 1).alias("n_near"))
