"""Scans of files, stored tables and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.calendar import from_epoch_ms
from tidemill.functions.scalars import nan_to_null

READING = T.StructType([T.StructField("ts", T.LongType()), T.StructField("value", T.DoubleType())])


def src_csv(spark: SparkSession, path: str, schema: T.StructType | str, first: str = "Date", **options) -> DataFrame:
    """Delimited file with a declared schema (no inference pass); the first column is renamed.

    A NaN cell is a missing one, so it becomes null here and no average meets it."""
    df = spark.read.schema(schema).csv(path, header=True, **options)
    clean = {c: nan_to_null(f"`{c}`").cast(kind).alias(c) for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[clean.get(c, F.col(f"`{c}`")) for c in df.columns]).withColumnRenamed(df.columns[0], first)


def src_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def src_json_series(df: DataFrame, json_col: str, root: str = "price", keys: tuple[str, ...] = (),
                    value: str = "value") -> DataFrame:
    """Payload ``{root: [{ts, value}]}`` to one row a reading, epoch milliseconds to UTC time."""
    payload = F.from_json(json_col, T.StructType([T.StructField(root, T.ArrayType(READING))]))
    return df.select(*keys, F.explode(payload[root]).alias("_r")).select(
        *keys, from_epoch_ms("_r.ts").alias("time"), F.col("_r.value").alias(value))


def json_payload(readings: DataFrame, by: list[str], ts_ms: Column, value: Column, root: str = "price") -> DataFrame:
    """The inverse: one payload per group. Groups must be small (a day of hourly readings)."""
    cells = F.sort_array(F.collect_list(F.struct(ts_ms.alias("ts"), value.alias("value"))))
    return readings.groupBy(*by).agg(F.to_json(F.struct(cells.alias(root))).alias("payload"))


def src_sql_range(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Closed time range; the literals take the column's type, so the filter reaches the scan."""
    kind = df.schema[col].dataType.simpleString()
    return df.filter(F.col(col).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))


def src_jdbc_range(spark: SparkSession, url: str, table: str, col: str, lo: str, hi: str,
                   partitions: int = 64, **options) -> DataFrame:
    """Range read of a database table, split on the range column so executors read in parallel."""
    df = (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=col, lowerBound=lo,
                                            upperBound=hi, numPartitions=partitions, **options).load())
    return src_sql_range(df, col, lo, hi)
