"""Keep-first merge, in memory and into a table of deltas.

The stored table is a folder of runs. A merge writes one run, the batch's own rows, and reads nothing back;
reading takes, per key and column, the first non-null value in the order of the runs. After ``fan`` runs of
one level a merge folds them into one of the next level, so a row is written again once a level and a
reader meets fewer than ``fan`` runs a level. The folder is its own manifest: a run's name says which merges
it holds, its success file that it is whole, and a run held by a wider whole one counts no longer. Such runs,
and those of a writer that was lost, go with a later merge, so a reader that has begun has that long to end.
One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.layout import names


def keep_first(rows: DataFrame, key: str | Sequence[str], value_cols: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Per key and column, the first non-null value in arrival order; later values never win."""
    order = F.struct(*seq)
    return rows.groupBy(*names(key)).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in value_cols])


def sink_upsert(existing: DataFrame, new: DataFrame, key: str | Sequence[str], value_cols: Sequence[str],
                seq_col: str | None = None) -> DataFrame:
    """``existing`` (one row per key) merged with ``new`` (arrival order in ``seq_col``)."""
    keys = names(key)
    seq = F.col(seq_col) if seq_col else F.lit(0)
    old_rows = existing.select(*keys, *value_cols, F.lit(0).alias("_age"), F.lit(None).cast("long").alias("_seq"))
    new_rows = new.select(*keys, *value_cols, F.lit(1).alias("_age"), seq.cast("long").alias("_seq"))
    return keep_first(old_rows.unionByName(new_rows), keys, value_cols, ["_age", "_seq"])


PART = "part_date"
FAN = 8
RUN_NAME = re.compile(r"run=r(\d+)-(\d+)-(\d+)")


@dataclass(frozen=True)
class Run:
    """Merges ``first`` to ``last``; ``level`` counts how often they were folded."""

    first: int
    last: int
    level: int = 0

    @property
    def name(self) -> str:
        return f"run=r{self.first}-{self.last}-{self.level}"


class Folder:
    """The table's folder, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def runs(self) -> tuple[list[Run], list[Run]]:
        """Runs that make up the table, in order, and those that do not count."""
        if not self._fs.exists(self._at(self.path)):
            return [], []
        matches = [RUN_NAME.fullmatch(f.getPath().getName()) for f in self._fs.listStatus(self._at(self.path))]
        found = [Run(*map(int, m.groups())) for m in matches if m]
        live, reached = [], 0
        for run in sorted(found, key=lambda r: (r.first, -r.last, -r.level)):
            if run.last > reached and self._fs.exists(self._at(f"{self.path}/{run.name}/_SUCCESS")):
                live.append(run)
                reached = run.last
        return live, [r for r in found if r not in live]

    def read(self, runs: Sequence[Run]) -> DataFrame | None:
        """Rows ``(_key, _value, _run, part_date)`` of the runs; None without any row."""
        if not runs:
            return None
        try:
            return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{r.name}" for r in runs]).drop("run")
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    def write(self, rows: DataFrame, run: Run) -> None:
        """Rows ``(_key, _value, part_date)`` as a run. Rebalancing keeps files few and splits a day that is too large for one task."""
        (rows.withColumn("_run", F.lit(run.first).cast("long")).hint("rebalance", PART).write.mode("overwrite")
         .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
         .partitionBy(PART).parquet(f"{self.path}/{run.name}"))

    def remove(self, runs: Sequence[Run]) -> None:
        for run in runs:
            self._fs.delete(self._at(f"{self.path}/{run.name}"), True)


def _folded(rows: DataFrame) -> DataFrame:
    """One row a key of several runs: per column the first known value. A key's rows share its day."""
    value = [F.col(f"_value.`{c}`") for c in rows.schema["_value"].dataType.names]
    firsts = [F.min_by(c, F.when(c.isNotNull(), F.col("_run"))) for c in value]
    return rows.groupBy(PART, "_key").agg(F.struct(*[f.alias(c) for f, c in zip(firsts, rows.schema["_value"].dataType.names)]).alias("_value"))


def _current(spark: SparkSession, path: str, days: Column | None = None) -> DataFrame | None:
    folder = Folder(spark, path)
    live, _ = folder.runs()
    rows = folder.read(live)
    if rows is None:
        return None
    rows = rows if days is None else rows.filter(days)
    return (rows if len(live) == 1 else _folded(rows)).select("_key.*", "_value.*")


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The keyed table, one row a key; None before the first merge."""
    return _current(spark, path)


def read_recent(spark: SparkSession, path: str, from_day) -> DataFrame | None:
    """Rows of the days from ``from_day`` on; earlier days are not read."""
    return _current(spark, path, F.col(PART) >= F.lit(from_day))


def merge_keyed(batch: DataFrame, path: str, key: Sequence[str], value_cols: Sequence[str], time_col: str,
                seq_col: str | None = None, fan: int = FAN) -> None:
    """Keep-first merge of a batch into the table at ``path``, whose runs are cut by the day of ``time_col``, a key column.

    All merges name the same columns. Rows without a time are left out. Values already there win, so merging
    the same batch again (a retried micro-batch) changes nothing.
    """
    if time_col not in key:
        raise ValueError(f"{time_col} must be a key column")
    folder = Folder(batch.sparkSession, path)
    live, stale = folder.runs()
    seq = F.col(seq_col).cast("long") if seq_col else F.lit(0).cast("long")
    rows = batch.filter(F.col(time_col).isNotNull()).select(*key, *value_cols, seq.alias("_seq"))
    ready = keep_first(rows, key, value_cols, ["_seq"]).select(
        F.struct(*key).alias("_key"), F.struct(*value_cols).alias("_value"), F.to_date(time_col).alias(PART))
    number = max([0, *[r.last for r in live + stale]]) + 1
    folder.write(ready, Run(number, number))
    live.append(Run(number, number))
    while len(live) >= fan and len({r.level for r in live[-fan:]}) == 1:
        tail = live[-fan:]
        wide = Run(tail[0].first, tail[-1].last, tail[-1].level + 1)
        found = folder.read(tail)
        if found is None:
            break
        folder.write(_folded(found), wide)
        live[-fan:] = [wide]
    folder.remove(stale)
