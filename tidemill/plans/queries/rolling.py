"""Rolling sensor forecast: streams run to the end of the given files, batch parts run whole."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemill.plans.catalog import half_up, half_up_sql, query
from tidemill.plans.queries.joins import BACKFILL
from tidemill.plans.queries.sources import scratch
from tidemill.plans.standins import hourly_readings, table
from tidemill.sources import model_store
from tidemill.sources.upsert import read_keyed
from tidemill.streaming import sensor

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
S = ["series"]


def stream(spark, d):
    return sensor.st_source(spark, f"{d}/events.parque[t]", EVENTS)


def drain(spark, df, name: str):
    """Run a stream over all files there are and read back what it wrote."""
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    sensor.st_hourly(writer, available_now=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("st_source", """SELECT event_id, ts, value FROM events""")
def st_source(spark, d):
    df = stream(spark, d).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    return drain(spark, df, "source")


@query("st_late", """SELECT event_id, event_type FROM events""")
def st_late(spark, d):
    """Every event comes twice; the second copies are dropped within the delay."""
    twice = stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return drain(spark, sensor.st_late(twice, ["event_id"]).select("event_id", "event_type"), "late")


@query("st_late_batch", """SELECT event_type AS series, date_trunc('hour', ts) AS "time", MIN(event_id) AS event_id
FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def st_late_batch(spark, d):
    """The batch form: one row per series and hour, the first to arrive."""
    from tidemill.operators.clean import dedup_time

    rows = table(spark, d, "events").select(F.col("event_type").alias("series"),
                                            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), "event_id")
    return dedup_time(rows, ["series", "time"], "event_id")


@query("st_hourly", f"""WITH last AS (SELECT date_trunc('millisecond', MAX(ts)) - INTERVAL 100 HOUR AS w FROM events)
SELECT event_type AS series, date_trunc('hour', ts) AS "time", {half_up_sql("AVG(value)", 6)} AS value, COUNT(*) AS n
FROM events, last GROUP BY event_type, date_trunc('hour', ts), w HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= w""")
def st_hourly(spark, d):
    """Hourly means of the closed hours: those the watermark has passed."""
    events = stream(spark, d).withColumnRenamed("event_type", "series")
    out = drain(spark, sensor.st_hourly_mean(events, S, "ts", "value"), "hourly")
    return out.select("series", F.col("time").cast("timestamp_ntz").alias("time"), half_up("value", 6).alias("value"), "n")


def readings_stream(spark, d):
    hour = F.date_trunc("hour", "ts")
    return stream(spark, d).select(F.col("event_type").alias("series"), hour.alias("time"), "event_id", F.col("value").alias(sensor.ACTUAL))


@query("st_upsert", """SELECT event_type AS series, date_trunc('hour', ts) AS "time", arg_min(value, event_id) AS elec_prices_metric
FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def st_upsert(spark, d):
    path, checkpoint = scratch(spark, "upsert"), scratch(spark, "upsert-checkpoint")
    sensor.st_upsert(readings_stream(spark, d), path, ["series", "time"], [sensor.ACTUAL], "time", checkpoint,
                     seq_col="event_id", available_now=True).awaitTermination()
    return read_keyed(spark, path).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("st_backfill", f"""WITH {BACKFILL}
SELECT series, origin, MAX(ts) AS last_ts, {half_up_sql("SUM(value * rn) FILTER (WHERE rn <= 100)", 3)} AS weighted,
  CAST(isodow(origin + INTERVAL 1 DAY) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(origin + INTERVAL 1 DAY) AS INTEGER) AS day_of_year,
  CAST(weekofyear(origin + INTERVAL 1 DAY) AS INTEGER) AS week_of_year
FROM seen GROUP BY series, origin HAVING COUNT(*) >= 100""")
def st_backfill(spark, d):
    """Origins and features of all historical forecasts in one plan."""
    rows = sensor.st_backfill(hourly_readings(spark, d), S, "ts", "value")
    places = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.get("history", i - 1) * i)
    return rows.select("series", "origin", "last_ts", half_up(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 3).alias("weighted"),
                       "day_of_week", "day_of_year", "week_of_year")


# The training range of the given readings.
TRAIN = (datetime(2024, 1, 1), datetime(2024, 1, 25))


def retrained(spark, d):
    """Trained, stored and loaded again, as a loop that starts anew would find it."""
    model = sensor.st_retrain(hourly_readings(spark, d), S, "ts", "value", *TRAIN, alpha=10.0)
    if model is None:
        return None
    path = scratch(spark, "retrained")
    model_store.save_model(spark, model, path)
    return model_store.load_model(spark, path)


@query("st_retrain")
def st_retrain(spark, d):
    """A model a step; rows are the fitted numbers (24 steps x 103 features)."""
    model = retrained(spark, d)
    rows = [(step, f, float(c)) for step, fit in enumerate(model.fits if model else []) for f, c in zip(fit.features, fit.coef)]
    return spark.createDataFrame(rows, "step int, feature string, coef double").withColumn("coef", half_up("coef", 6))


@query("st_forecast")
def st_forecast(spark, d):
    """24 rows from the last reading of each series, and from every historical origin."""
    readings = hourly_readings(spark, d)
    model = retrained(spark, d)
    latest = sensor.latest_origins(readings, S, "ts", "value")
    origins = latest.unionByName(sensor.backfill_origins(readings, S, "ts")).distinct()
    out = sensor.st_forecast(readings, origins, model, S, "ts", "value")
    return out.withColumn(sensor.FORECAST, half_up(sensor.FORECAST, 4))


@query("st_rolling_loop")
def st_rolling_loop(spark, d):
    """The loop itself: stream in, merge, forecast after the batch, forecasts merged into the same table."""
    path, checkpoint = scratch(spark, "loop"), scratch(spark, "loop-checkpoint")
    model = retrained(spark, d)
    sensor.run_rolling_forecast(readings_stream(spark, d), path, checkpoint, model, S, available_now=True, seq_col="event_id").awaitTermination()
    return read_keyed(spark, path).select("series", F.col("time").cast("timestamp_ntz").alias("time"),
                                          half_up(sensor.FORECAST, 4).alias(sensor.FORECAST))


@query("st_rolling_readings", """SELECT event_type AS series, date_trunc('hour', ts) AS "time", arg_min(value, event_id) AS elec_prices_metric
FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def st_rolling_readings(spark, d):
    """The loop over several micro-batches: hours keep the value that came first, whatever the batches merge."""
    path, checkpoint, files = scratch(spark, "loop"), scratch(spark, "loop-checkpoint"), scratch(spark, "loop-files")
    events = table(spark, d, "events")
    lo, hi = events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.floor((F.col("event_id") - lo) * 3 / (hi - lo + 1))
    model = retrained(spark, d)
    for k in range(3):
        # The loop stops when it has read a part and goes on from its checkpoint with the next.
        events.filter(part == k).write.mode("append").parquet(files)
        stream_ = sensor.st_source(spark, files, events.schema)
        rows = stream_.select(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("time"), "event_id", F.col("value").alias(sensor.ACTUAL))
        sensor.run_rolling_forecast(rows, path, checkpoint, model, S, available_now=True, seq_col="event_id").awaitTermination()
    return read_keyed(spark, path).filter(F.col(sensor.ACTUAL).isNotNull()).select(
        "series", F.col("time").cast("timestamp_ntz").alias("time"), sensor.ACTUAL)
