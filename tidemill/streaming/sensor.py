"""New readings in, keep-first merge, 24-hour forecasts out.

The forecast model works on the last ``n`` readings (newest first) and three calendar features. Every
part is a batch DataFrame function used inside ``foreachBatch``, so stream and batch results agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidemill.functions.calendar import calendar_features, shift_time
from tidemill.operators.joins import join_asof_last_n
from tidemill.operators.layout import complete_rows, with_neighbours
from tidemill.ml.models import MultiOutput, fit_multi_output
from tidemill.sources.upsert import merge_keyed, read_keyed, read_recent

HISTORY = 100
STEPS_AHEAD = 24
CADENCE = "1 hour"
OVERLAP = "100 hours"
ACTUAL, FORECAST = "elec_prices_metric", "elec_prices"


def st_source(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", time_col: str = "ts",
              max_files: int | None = None) -> DataFrame:
    """Stream of files; a zone-free time column becomes a UTC timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(path)
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))


def st_late(stream: DataFrame, key: Sequence[str], time_col: str = "ts", delay: str = OVERLAP) -> DataFrame:
    """Accept rows up to ``delay`` late and drop repeats of a key within that time."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(key))


def st_hourly_mean(stream: DataFrame, s: Sequence[str], time_col: str, value: str, delay: str = OVERLAP) -> DataFrame:
    """Hourly series from raw readings; an hour is emitted once no row of it can still come."""
    hour = F.window(time_col, "1 hour")
    agg = stream.withWatermark(time_col, delay).groupBy(*s, hour).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))
    return agg.select(*s, F.col("window.start").alias("time"), value, "n")


def st_hourly(writer: DataStreamWriter, available_now: bool = False, cadence: str = CADENCE) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=cadence)


def st_upsert(stream: DataFrame, path: str, key: Sequence[str], value_cols: Sequence[str], time_col: str, checkpoint: str,
              seq_col: str | None = None, available_now: bool = False,
              after: Callable[[DataFrame, int], None] | None = None):
    """Keep-first merge of every micro-batch; ``after`` runs on the merged batch.

    A retried batch merges to the same table, because values already there win.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        # The merge and what follows read the batch several times; the stream's own work is done once.
        df = df.persist()
        try:
            if not df.isEmpty():
                merge_keyed(df, path, key, value_cols, time_col, seq_col)
                if after is not None:
                    after(df, batch_id)
        finally:
            df.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return st_hourly(writer, available_now).start()


def forecast_features(vectors: DataFrame, origin: str = "origin") -> DataFrame:
    """History and the calendar of the day after the origin, one feature a column."""
    return vectors.withColumns(calendar_features(origin)).withColumns(
        {f"h{i + 1}": F.col("history")[i] for i in range(HISTORY)})


FEATURES = [*[f"h{i + 1}" for i in range(HISTORY)], "day_of_week", "day_of_year", "week_of_year"]


def forecast_rows(features: DataFrame, model: MultiOutput, s: Sequence[str], origin: str = "origin",
                  time_col: str = "time") -> DataFrame:
    """24 rows an origin; the first one is the origin hour itself."""
    # One small matrix of coefficients as a literal, instead of 24 sums of 103 terms each.
    matrix = ",".join("array(" + ",".join(f"{c!r}D" for c in fit.coef) + ")" for fit in model.fits)
    starts = "array(" + ",".join(f"{fit.intercept!r}D" for fit in model.fits) + ")"
    inputs = F.array(*[F.col(f"`{f}`").cast("double") for f in model.fits[0].features])
    steps = F.zip_with(F.expr(f"array({matrix})"), F.expr(starts), lambda coef, start: F.aggregate(
        F.zip_with(inputs, coef, lambda x, c: x * c), start, lambda total, part: total + part))
    long = features.select(*s, origin, F.posexplode(steps).alias("offset", FORECAST))
    return long.withColumn(time_col, shift_time(origin, hours=F.col("offset"))).select(*s, origin, time_col, "offset", FORECAST)


def latest_origins(readings: DataFrame, s: Sequence[str], o: str, value: str) -> DataFrame:
    return readings.filter(F.col(value).isNotNull()).groupBy(*s).agg(F.max(o).alias("origin"))


def backfill_origins(readings: DataFrame, s: Sequence[str], o: str, step: str = "24 hours",
                     warmup_hours: int = HISTORY, latest: Column | None = None) -> DataFrame:
    """Origins from the first reading plus the warm-up on, every ``step`` up to the latest reading."""
    ends = readings.groupBy(*s).agg(F.min(o).alias("lo"), F.max(o).alias("hi"))
    lo, hi = shift_time("lo", hours=warmup_hours), F.col("hi") if latest is None else latest
    return ends.select(*s, F.explode(F.when(lo <= hi, F.sequence(lo, hi, F.expr(f"interval {step}")))).alias("origin"))


def st_backfill(readings: DataFrame, s: Sequence[str], o: str, value: str, step: str = "24 hours",
                n: int = HISTORY, max_rows: int | None = None) -> DataFrame:
    """Feature rows of all historical origins, in one plan instead of a query per origin."""
    origins = backfill_origins(readings, s, o, step, n)
    vectors = join_asof_last_n(origins, readings, s, o, value, n, "origin", max_rows)
    return vectors.withColumns(calendar_features("origin"))


def st_forecast(readings: DataFrame, origins: DataFrame, model: MultiOutput, s: Sequence[str], o: str, value: str,
                max_rows: int | None = None) -> DataFrame:
    vectors = join_asof_last_n(origins, readings, s, o, value, HISTORY, "origin", max_rows)
    return forecast_rows(forecast_features(vectors), model, s)


def training_range(now: datetime) -> tuple[datetime, datetime]:
    """The 365 days that end a quarter of a year before ``now``."""
    end = now - timedelta(days=365 / 4)
    return end - timedelta(days=365), end


def training_rows(readings: DataFrame, s: Sequence[str], o: str, value: str, max_rows: int | None = None) -> DataFrame:
    """Per reading: the history up to it, its calendar and the values of the hours from it on."""
    known = readings.filter(F.col(value).isNotNull()).select(*s, o, value)

    def build(near):
        w = near.window
        out = {f"h{i + 1}": (F.lag(value, i).over(w) if i else F.col(value)) for i in range(HISTORY)}
        return out | {f"t{i}": (F.lead(value, i).over(w) if i else F.col(value)) for i in range(STEPS_AHEAD)}

    wide = with_neighbours(known, s, o, HISTORY - 1, STEPS_AHEAD - 1, build, max_rows)
    return complete_rows(wide.withColumns(calendar_features(o)), ["h100", f"t{STEPS_AHEAD - 1}"])


def st_retrain(readings: DataFrame, s: Sequence[str], o: str, value: str, lo: datetime | None = None, hi: datetime | None = None,
               alpha: float = 1.0, min_rows: int = 100, max_rows: int | None = None, now: datetime | None = None) -> MultiOutput | None:
    """A ridge model a step from the readings of a range; None when the range holds too few rows.

    Without a range it is the training range that belongs to ``now``."""
    if lo is None or hi is None:
        lo, hi = training_range(now or datetime.now(timezone.utc).replace(tzinfo=None))
    kind = readings.schema[o].dataType.simpleString()
    window = readings.filter(F.col(o).between(F.lit(str(lo)).cast(kind), F.lit(str(hi)).cast(kind)))
    if window.limit(min_rows).count() < min_rows:
        return None
    rows = training_rows(window, s, o, value, max_rows)
    return fit_multi_output(rows, FEATURES, [f"t{i}" for i in range(STEPS_AHEAD)], "ridge", alpha=alpha)


def recent_readings(spark: SparkSession, path: str, touched: DataFrame, s: Sequence[str], from_day, value: str = ACTUAL,
                    n: int = HISTORY) -> DataFrame:
    """Stored rows holding the last ``n`` readings of the touched series.

    Only days from ``from_day`` on are read; series too sparse to have ``n`` readings there are read
    whole.
    """
    recent = read_recent(spark, path, from_day).join(touched, list(s), "left_semi")
    enough = recent.filter(F.col(value).isNotNull()).groupBy(*s).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    sparse = touched.join(enough, list(s), "left_anti")
    if sparse.isEmpty():
        return recent
    whole = read_keyed(spark, path).join(sparse, list(s), "left_semi")
    return recent.join(sparse, list(s), "left_anti").unionByName(whole)


def run_rolling_forecast(stream: DataFrame, path: str, checkpoint: str, model: MultiOutput, s: Sequence[str],
                         available_now: bool = False, reach_days: int = 14, max_rows: int | None = None, seq_col: str | None = None):
    """The whole loop; ``seq_col`` gives the order of arrival, so the first value of an hour stays. Readings ``(series.., time, elec_prices_metric)`` are merged; after each batch the
    last 100 readings of the touched series give 24 forecasts, merged into the same table."""
    def after(df: DataFrame, batch_id: int) -> None:
        first = df.agg(F.date_sub(F.to_date(F.min("time")), reach_days)).first()[0]
        touched = df.select(*s).distinct()
        readings = recent_readings(df.sparkSession, path, touched, s, first)
        out = st_forecast(readings, latest_origins(readings, s, "time", ACTUAL), model, s, "time", ACTUAL, max_rows)
        rows = out.select(*s, "time", F.lit(None).cast("double").alias(ACTUAL), FORECAST)
        merge_keyed(rows, path, [*s, "time"], [ACTUAL, FORECAST], "time")

    ready = stream.withColumn(FORECAST, F.lit(None).cast("double"))
    return st_upsert(ready, path, [*s, "time"], [ACTUAL, FORECAST], "time", checkpoint,
                     seq_col=seq_col, available_now=available_now, after=after)
