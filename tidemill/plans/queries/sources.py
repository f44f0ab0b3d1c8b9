"""Scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemill.ml.models import fit_linear
from tidemill.operators.clean import wide_clean
from tidemill.operators.reshape import reshape_unpivot
from tidemill.plans.catalog import query
from tidemill.plans.standins import (
    GAPS,
    HOURLY,
    INFLATION,
    NATIONS,
    PANEL,
    PRICES,
    gap_panel,
    hourly_readings,
    monthly_inflation,
    price_sheet,
    table,
    weekly_panel,
)
from tidemill.session import ensure_checkpoint_dir
from tidemill.sources import model_store
from tidemill.sources.readers import json_payload, src_csv, src_json_series, src_sql_range, src_table
from tidemill.sources.upsert import merge_keyed, read_keyed, sink_upsert
from tidemill.sources.writers import best_update, sink_results, sink_table


def scratch(spark, name: str) -> str:
    """A fresh folder next to the checkpoints, which all executors reach."""
    return f"{ensure_checkpoint_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


@query("src_csv", f"""WITH {INFLATION}
SELECT strftime(ts, '%Y-%m') AS "Date", eu, ireland FROM inflation""")
def src_csv_query(spark, d):
    """Inflation text file with a declared schema, the first column renamed."""
    path = scratch(spark, "inflation")
    month = monthly_inflation(spark, d).select(F.date_format("ts", "yyyy-MM").alias("observation"), "eu", "ireland")
    sink_table(month, path, fmt="csv", header=True)
    return src_csv(spark, path, "observation string, eu double, ireland double")


@query("src_table", f"""WITH {PANEL} SELECT series, ts, litres, num_suppliers FROM panel""")
def src_table_query(spark, d):
    """The stored weekly dataset, read back with its columns pruned."""
    path = scratch(spark, "panel")
    sink_table(weekly_panel(spark, d), path)
    return src_table(spark, path).select("series", "ts", "litres", "num_suppliers")


@query("src_wide_clean", f"""WITH {PRICES},
months AS (SELECT DISTINCT ts FROM prices),
cells AS (SELECT m.ts, n.n_name AS series FROM months m CROSS JOIN nation n WHERE n_name <> 'NATION_3')
SELECT strftime(c.ts, '%YM%m') AS month, c.series, p.price
FROM cells c LEFT JOIN prices p ON c.ts = p.ts AND c.series = p.series""")
def src_wide_clean_query(spark, d):
    sheet = price_sheet(spark, d)
    clean = wide_clean(sheet, "month", drop=["NATION_3"], key_pattern=r"^\d{4}M\d{2}$")
    kept = [c for c in NATIONS if c != "NATION_3"]
    return reshape_unpivot(clean, ["month"], kept, "series", "price")


@query("src_json_series", f"""WITH {HOURLY}
SELECT series, ts AS "time", ROUND(value, 6) AS value FROM hourly""")
def src_json_series_query(spark, d):
    """Payloads of one day of hourly readings each (24 cells at most), taken apart again."""
    hourly = hourly_readings(spark, d).withColumn("day", F.to_date("ts"))
    payloads = json_payload(hourly, ["series", "day"], F.unix_millis(F.col("ts").cast("timestamp")), F.round("value", 6))
    rows = src_json_series(payloads, "payload", keys=("series",))
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("src_json_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def src_json_props_query(spark, d):
    props = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", props["k"].alias("k"))


@query("src_sql_range", """SELECT event_id, ts, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-15 12:00:00'""")
def src_sql_range_query(spark, d):
    return src_sql_range(table(spark, d, "events").select("event_id", "ts", "value"), "ts", "2024-01-08 00:00:00",
                         "2024-01-15 12:00:00")


@query("sink_table", f"""WITH {PANEL}
SELECT series, COUNT(*) AS weeks, ROUND(SUM(litres), 2) AS litres FROM panel GROUP BY series""")
def sink_table_query(spark, d):
    path = scratch(spark, "stage")
    sink_table(weekly_panel(spark, d), path, ["series"])
    return src_table(spark, path).groupBy("series").agg(
        F.count(F.lit(1)).alias("weeks"), F.round(F.sum("litres"), 2).alias("litres"))


@query("sink_results", f"""WITH {PANEL}
SELECT series AS model, 'litres' AS target, ts, litres AS prediction FROM panel""")
def sink_results_query(spark, d):
    path = scratch(spark, "results")
    rows = weekly_panel(spark, d).select(F.lit("litres").alias("target"), F.col("series").alias("model"), "ts",
                                         F.col("litres").alias("prediction"))
    sink_results(rows, path)
    return spark.read.parquet(path)


# Arrival order of the readings, and two columns that are each known for some of them only.
ARRIVALS = """arrivals AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS "time", event_id AS seq,
         CASE WHEN user_id % 3 <> 0 THEN value END AS metric, CASE WHEN user_id % 2 = 0 THEN value END AS price
  FROM events)"""


def arrivals(spark, d):
    events = table(spark, d, "events")
    return events.select(
        F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"),
        F.col("event_id").alias("seq"), F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("metric"),
        F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("price"))


UPSERT_SQL = f"""WITH {ARRIVALS}
SELECT series, "time", arg_min(metric, seq) FILTER (WHERE metric IS NOT NULL) AS metric,
       arg_min(price, seq) FILTER (WHERE price IS NOT NULL) AS price
FROM arrivals GROUP BY series, "time" """


@query("sink_upsert", UPSERT_SQL)
def sink_upsert_query(spark, d):
    """Keep-first per column: the earlier half of the arrivals is there, the later half is merged."""
    rows = arrivals(spark, d)
    middle = rows.agg(F.percentile_approx("seq", 0.5)).scalar()
    early, late = rows.filter(F.col("seq") <= middle), rows.filter(F.col("seq") > middle)
    key, cols = ["series", "time"], ["metric", "price"]
    empty = rows.select(*key, *cols).limit(0)
    return sink_upsert(sink_upsert(empty, early, key, cols, "seq"), late, key, cols, "seq")


@query("sink_upsert_table", UPSERT_SQL)
def sink_upsert_table_query(spark, d):
    """The same merge, batch by batch, into the stored table; the second batch comes twice."""
    path = scratch(spark, "sensor")
    rows = arrivals(spark, d)
    middle = rows.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for batch in (rows.filter(F.col("seq") <= middle), rows.filter(F.col("seq") > middle),
                  rows.filter(F.col("seq") > middle)):
        merge_keyed(batch, path, ["series", "time"], ["metric", "price"], "time", "seq")
    return read_keyed(spark, path)


@query("model_store", f"""WITH {PANEL}
SELECT series, ts, ROUND((SELECT regr_intercept(litres, n_orders) FROM panel)
  + (SELECT regr_slope(litres, n_orders) FROM panel) * n_orders, 2) AS prediction FROM panel""")
def model_store_query(spark, d):
    """Fit, save, load, predict."""
    path = scratch(spark, "model")
    panel = weekly_panel(spark, d)
    fitted = fit_linear(panel, ["n_orders"], "litres")
    model_store.save(fitted.pipeline, path)
    fitted.pipeline = model_store.load(path)
    return fitted.transform(panel).select("series", "ts", F.round("prediction", 2).alias("prediction"))


@query("best_update", f"""WITH {PANEL}, best AS (
  SELECT series AS model, MIN(litres) AS mape FROM panel GROUP BY series)
SELECT model, ROUND(CASE WHEN model IN ('1-URGENT', '5-LOW') THEN mape / 2 ELSE mape END, 4) AS mape FROM best""")
def best_update_query(spark, d):
    """A global table of best records; two models get new ones, the others stay."""
    path = scratch(spark, "best")
    best = weekly_panel(spark, d).groupBy(F.col("series").alias("model")).agg(F.min("litres").alias("mape"))
    best_update(best, path)
    new = best.filter(F.col("model").isin("1-URGENT", "5-LOW")).withColumn("mape", F.col("mape") / 2)
    best_update(new, path)
    return spark.read.parquet(path).select("model", F.round("mape", 4).alias("mape"))


@query("null_gap_source", f"""WITH {GAPS} SELECT series, ts, litres, n_orders FROM gaps""")
def gap_query(spark, d):
    """The weekly grid all gap handling starts from."""
    return gap_panel(spark, d).select("series", "ts", "litres", "n_orders")
