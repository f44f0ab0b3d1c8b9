"""Column choice and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import clean
from tidemill.operators.reshape import reshape_unpivot
from tidemill.plans.catalog import query
from tidemill.plans.standins import (
    GAPS,
    HOURLY,
    PANEL,
    WEATHER,
    gap_panel,
    hourly_readings,
    table,
    weather_wide,
    weekly_panel,
)

@query("proj_suffix", f"""WITH {WEATHER}, days AS (SELECT DISTINCT ts FROM weather)
SELECT d.ts, n.n_name || '_rain' AS name, ROUND(w.rain, 4) AS value
FROM days d CROSS JOIN nation n LEFT JOIN weather w ON w.ts = d.ts AND w.station = n.n_name""")
def proj_suffix(spark, d):
    rain = clean.proj_suffix(weather_wide(spark, d), ["_rain"], keys=["ts"])
    return reshape_unpivot(rain, ["ts"], clean.suffix_columns(rain, ["_rain"]), "name", "value").withColumn(
        "value", F.round("value", 4))


@query("proj_regex", f"""WITH {PANEL} SELECT ts, litres, top_price FROM panel""")
def proj_regex(spark, d):
    return clean.proj_regex(weekly_panel(spark, d), "litres|price|^ts$")


@query("proj_numeric", f"""WITH {PANEL} SELECT series, ts, litres, num_suppliers, n_orders, top_price, week FROM panel""")
def proj_numeric(spark, d):
    return clean.proj_numeric(weekly_panel(spark, d), keys=["series", "ts"])


@query("proj_drop", f"""WITH {PANEL} SELECT series, ts, litres, week FROM panel""")
def proj_drop(spark, d):
    return clean.proj_drop(weekly_panel(spark, d), ["num_suppliers", "n_orders", "top_price", "not_there"])


@query("proj_keep", f"""WITH {PANEL} SELECT ts, series, n_orders FROM panel""")
def proj_keep(spark, d):
    return clean.proj_keep(weekly_panel(spark, d), ["ts", "series", "n_orders", "not_there"])


@query("proj_reorder", f"""WITH {PANEL} SELECT ts, week, series, litres, num_suppliers, n_orders, top_price FROM panel""")
def proj_reorder(spark, d):
    return clean.proj_reorder(weekly_panel(spark, d), ["ts", "week"])


@query("proj_rename", f"""WITH {PANEL} SELECT series, ts, litres AS "litres_Milk", num_suppliers AS "num_suppliers_Milk",
n_orders AS "n_orders_Milk", top_price AS "top_price_Milk", week AS "week_Milk" FROM panel""")
def proj_rename(spark, d):
    return clean.proj_rename(weekly_panel(spark, d), suffix="_Milk", keys=["series", "ts"])


@query("proj_dedup_cols", f"""WITH {PANEL} SELECT series, ts, litres FROM panel""")
def proj_dedup_cols(spark, d):
    panel = weekly_panel(spark, d)
    doubled = panel.select("series", "ts", "litres", F.col("n_orders").alias("litres"))
    return clean.proj_dedup_cols(doubled)


@query("filter_date_range", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'""")
def filter_date_range(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return clean.filter_date_range(orders, "o_orderdate", "1996-01-01", "1997-12-31").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("filter_month_string", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders
WHERE strftime(o_orderdate, '%Y-%m') >= '1996-01-01' AND strftime(o_orderdate, '%Y-%m') <= '1999-12-31'""")
def filter_month_string(spark, d):
    months = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return clean.filter_month_string(months, "month", "1996-01-01", "1999-12-31")


@query("filter_dropna", f"""WITH {GAPS} SELECT series, ts, litres, n_orders FROM gaps
WHERE litres IS NOT NULL AND n_orders IS NOT NULL""")
def filter_dropna(spark, d):
    return clean.filter_dropna(gap_panel(spark, d).select("series", "ts", "litres", "n_orders"))


def with_zero_columns(spark, d):
    """Wide daily weather with two columns that hold zeros only, and one of zeros and nulls."""
    wide = weather_wide(spark, d)
    return wide.withColumns({"DRY_rain": F.lit(0.0), "DARK_sun": F.lit(0.0),
                             "GAP_soil": F.when(F.dayofmonth("ts") > 15, 0.0)})


@query("filter_allzero_cols", f"""WITH {WEATHER}
SELECT n_name || '_rain' AS column_name FROM nation WHERE n_name IN (SELECT station FROM weather)
UNION ALL SELECT n_name || '_soil' FROM nation WHERE n_name IN (SELECT station FROM weather)
UNION ALL SELECT n_name || '_sun' FROM nation WHERE n_name IN (SELECT station FROM weather)
UNION ALL SELECT n_name || k FROM nation, (VALUES ('_rain'), ('_soil'), ('_sun')) v(k)
  WHERE n_name NOT IN (SELECT station FROM weather)
UNION ALL SELECT 'GAP_soil'""")
def filter_allzero_cols(spark, d):
    """Names of the columns that stay; a null keeps a column."""
    df = with_zero_columns(spark, d)
    left = clean.filter_allzero_cols(df, [c for c in df.columns if c != "ts"])
    cells = left.unpivot(["ts"], [c for c in left.columns if c != "ts"], "column_name", "value")
    return cells.select("column_name").distinct()


@query("filter_not_null_asof", f"""WITH {HOURLY}
SELECT series, ts, ROUND(value, 6) AS value FROM hourly WHERE value IS NOT NULL AND ts <= TIMESTAMP '2024-01-20 06:00:00'""")
def filter_not_null_asof(spark, d):
    kept = clean.filter_not_null_asof(hourly_readings(spark, d), "value", "ts", "2024-01-20 06:00:00")
    return kept.select("series", "ts", F.round("value", 6).alias("value"))


@query("dedup_time", """SELECT event_type AS series, date_trunc('hour', ts) AS hour,
arg_min(value, event_id) AS value, MIN(event_id) AS event_id FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def dedup_time(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value", "event_id")
    return clean.dedup_time(rows, ["series", "hour"], "event_id")


@query("null_columns_report", f"""WITH {GAPS}
SELECT 'litres' AS column_name, COUNT(*) - COUNT(litres) AS null_count FROM gaps
UNION ALL SELECT 'series', COUNT(*) - COUNT(series) FROM gaps
UNION ALL SELECT 'n_orders', COUNT(*) - COUNT(n_orders) FROM gaps""")
def null_columns_report(spark, d):
    return clean.null_columns_report(gap_panel(spark, d).select("series", "litres", "n_orders"))


@query("check_columns", f"""WITH {PANEL} SELECT series, ts, litres, num_suppliers FROM panel""")
def check_columns(spark, d):
    panel = weekly_panel(spark, d).select("series", "ts", "litres", "num_suppliers")
    return clean.check_columns(panel, ["num_suppliers", "litres"], "litres")
