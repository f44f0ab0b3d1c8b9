"""Sinks for dataset stages and result records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def sink_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
               mode: str = "overwrite", **options) -> None:
    """Write a stage. Rebalancing on the partition columns keeps files few and splits hot ones."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).format(fmt).options(**options).partitionBy(*partition_by).save(path)


def sink_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("target", "model"),
                 dynamic: bool = False) -> None:
    """Result records; ``dynamic`` replaces only the partitions present in ``df``."""
    writer = df.write.mode("overwrite").format(fmt).partitionBy(*partition_by)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def best_update(best: DataFrame, path: str, partition_by: Sequence[str] = ("model",)) -> None:
    """Replace the records of the models in ``best``; other models' records stay."""
    sink_results(best, path, partition_by=partition_by, dynamic=True)
