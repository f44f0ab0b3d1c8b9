"""Comparing the rows of a group with each other without holding a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, keys: list[str], row_id: str, tile: int, groups: int) -> DataFrame:
    """Adds ``seg`` and ``grp``: rows that must be compared share a ``seg``, and ``grp`` is what to group by.

    ``cross`` says that a segment is for pairs of rows with different ``chunk`` only; who counts pairs must heed it.

    A key with up to ``tile`` rows is one segment, and many small segments share a group. A larger key is
    dealt by the hash of ``row_id`` into chunks of about ``tile`` rows, and a segment is a pair of chunks:
    every pair of rows meets in one, and no task sees more than about two chunks. Only the counts of
    large keys are joined back; Spark picks the join by their measured size.
    """
    key = F.xxhash64(*keys)
    keyed = rows.withColumn("_key", key)
    large = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    marked = keyed.join(large, "_key", "left")
    chunks = F.coalesce(F.ceil(F.col("_n") / tile), F.lit(1)).cast("long")
    chunk = F.pmod(F.xxhash64(F.col(row_id), F.lit("chunk")), chunks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    dealt = marked.withColumn("_chunk", chunk).withColumn("_other", other)
    lo, hi = F.least("_chunk", "_other"), F.greatest("_chunk", "_other")
    return dealt.withColumn("chunk", F.col("_chunk")).withColumn("cross", lo != hi).withColumn("seg", F.when(F.col("_n").isNull(), F.col("_key")).otherwise(F.xxhash64("_key", lo, hi))) \
        .withColumn("grp", F.when(F.col("_n").isNull(), F.pmod("_key", F.lit(groups))).otherwise(F.col("seg"))) \
        .drop("_key", "_n", "_chunk", "_other")
