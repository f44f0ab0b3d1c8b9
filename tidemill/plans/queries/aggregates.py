"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.calendar import week_key
from tidemill.operators import aggregates as agg
from tidemill.operators.split import split_ts_cv
from tidemill.plans.catalog import half_up, query
from tidemill.plans.standins import (
    HOURLY,
    PANEL,
    PRICES,
    WEATHER,
    hourly_readings,
    monthly_prices,
    table,
    weather_wide,
    weekly_panel,
)

KINDS = ("rain", "soil", "sun")

# Row means skip stations without readings that day; the SQL says it on the long form.
DAY_MEANS = WEATHER + """, day_means AS (
  SELECT ts, AVG(rain) AS mean_rain, AVG(soil) AS mean_soil, AVG(sun) AS mean_sun FROM weather GROUP BY ts)"""


def day_means(spark, d):
    wide = weather_wide(spark, d)
    for kind in KINDS:
        wide = agg.agg_row_mean(wide, f"_{kind}", f"mean_{kind}")
    return wide.select("ts", *[f"mean_{k}" for k in KINDS])


@query("agg_row_mean", f"""WITH {DAY_MEANS}
SELECT ts, CAST(ROUND(CAST(mean_rain AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_rain, CAST(ROUND(CAST(mean_soil AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_soil, CAST(ROUND(CAST(mean_sun AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_sun FROM day_means""")
def agg_row_mean(spark, d):
    return day_means(spark, d).select("ts", *[half_up(f"mean_{k}", 6).alias(f"mean_{k}") for k in KINDS])


@query("agg_week_mean", f"""WITH {DAY_MEANS}
SELECT CAST(year(ts) AS VARCHAR) || '_' || CAST(weekofyear(ts) AS VARCHAR) AS year_week,
  CAST(ROUND(CAST(AVG(mean_rain) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_rain, CAST(ROUND(CAST(AVG(mean_soil) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_soil, CAST(ROUND(CAST(AVG(mean_sun) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_sun
FROM day_means GROUP BY 1""")
def agg_week_mean(spark, d):
    """Mean of row means per calendar-year ISO week, colliding year ends pooled."""
    days = day_means(spark, d).withColumn("year_week", week_key("ts", "calendar_iso"))
    weekly = agg.agg_week_mean(days, "year_week", [f"mean_{k}" for k in KINDS])
    return weekly.select("year_week", *[half_up(f"mean_{k}", 6).alias(f"mean_{k}") for k in KINDS])


@query("agg_resample_mean", """WITH raw AS (
  SELECT o_orderpriority || '/' || o_orderstatus AS series, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS price FROM orders),
weeks AS (
  SELECT series, CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS ts,
         SUM(CAST(price AS DECIMAL(18,2))) AS total, COUNT(*) AS n FROM raw GROUP BY ALL),
grid AS (SELECT series, CAST(unnest(generate_series(MIN(ts), MAX(ts), INTERVAL 7 DAY)) AS DATE) AS ts FROM weeks GROUP BY series),
overall AS (SELECT series, CAST(SUM(total) AS DOUBLE) / SUM(n) AS price FROM weeks GROUP BY series)
SELECT g.series, g.ts, CAST(ROUND(CAST(COALESCE(CAST(w.total AS DOUBLE) / w.n, o.price) AS DECIMAL(38,7)), 3) AS DOUBLE) AS price
FROM grid g JOIN overall o USING (series) LEFT JOIN weeks w USING (series, ts)""")
def agg_resample_mean(spark, d):
    raw = table(spark, d, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("series"), F.col("o_orderdate").cast("date").alias("ts"),
        F.col("o_totalprice").alias("price"))
    return agg.agg_resample_mean(raw, ["series"], "ts", ["price"]).select("series", "ts", half_up("price", 3).alias("price"))


@query("agg_minmax_time", """SELECT event_type AS series, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM events GROUP BY event_type""")
def agg_minmax_time(spark, d):
    return agg.agg_minmax_time(table(spark, d, "events").withColumnRenamed("event_type", "series"), ["series"], "ts")


SUMMARY = PRICES + """, changed AS (
  SELECT series, ts, price, price / LAG(price) OVER (PARTITION BY series ORDER BY ts) - 1 AS change FROM prices)"""


@query("agg_pct_change_mean", f"""WITH {SUMMARY}
SELECT series, CAST(ROUND(CAST(AVG(change) * 100 AS DECIMAL(38,10)), 6) AS DOUBLE) AS avg_change FROM changed GROUP BY series""")
def agg_pct_change_mean(spark, d):
    changed = agg.win_pct_change(monthly_prices(spark, d), ["series"], "ts", "price", "_chg")
    return changed.groupBy("series").agg(half_up(agg.pct_change_mean(), 6).alias("avg_change"))


@query("agg_total_change", f"""WITH {SUMMARY}
SELECT series, CAST(ROUND(CAST(PRODUCT(1 + COALESCE(change, 0)) * 100 - 100 AS DECIMAL(38,10)), 6) AS DOUBLE) AS total_change FROM changed GROUP BY series""")
def agg_total_change(spark, d):
    changed = agg.win_pct_change(monthly_prices(spark, d), ["series"], "ts", "price", "_chg")
    return changed.groupBy("series").agg(half_up(agg.total_change(), 6).alias("total_change"))


@query("agg_mean_median", f"""WITH {PRICES}
SELECT series, CAST(ROUND(CAST(AVG(price) AS DECIMAL(38,7)), 3) AS DOUBLE) AS mean_price, CAST(ROUND(CAST(MEDIAN(price) AS DECIMAL(38,7)), 3) AS DOUBLE) AS median_price FROM prices GROUP BY series""")
def agg_mean_median(spark, d):
    return monthly_prices(spark, d).groupBy("series").agg(
        half_up(F.avg("price"), 3).alias("mean_price"), half_up(F.median("price"), 3).alias("median_price"))


@query("agg_price_summary", f"""WITH {SUMMARY}
SELECT series, CAST(ROUND(CAST(AVG(change) * 100 AS DECIMAL(38,10)), 6) AS DOUBLE) AS avg_change, CAST(ROUND(CAST(PRODUCT(1 + COALESCE(change, 0)) * 100 - 100 AS DECIMAL(38,10)), 6) AS DOUBLE) AS total_change,
  CAST(ROUND(CAST(AVG(price) AS DECIMAL(38,7)), 3) AS DOUBLE) AS mean_price, CAST(ROUND(CAST(MEDIAN(price) AS DECIMAL(38,7)), 3) AS DOUBLE) AS median_price
FROM changed GROUP BY series ORDER BY avg_change DESC, series""")
def agg_price_summary(spark, d):
    out = agg.agg_price_summary(monthly_prices(spark, d), ["series"], "ts", "price")
    return out.select("series", half_up("avg_change", 6).alias("avg_change"), half_up("total_change", 6).alias("total_change"),
                      half_up("mean_price", 3).alias("mean_price"), half_up("median_price", 3).alias("median_price"))


CORR_COLS = ["litres", "num_suppliers", "n_orders", "top_price"]
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CAST(ROUND(CAST(corr({a}, {b}) AS DECIMAL(38,12)), 8) AS DOUBLE) AS corr FROM panel"
    for a in CORR_COLS for b in CORR_COLS)


@query("agg_corr_matrix", f"""WITH {PANEL} {CORR_SQL}""")
def agg_corr_matrix(spark, d):
    return agg.agg_corr_matrix(weekly_panel(spark, d), CORR_COLS).withColumn("corr", half_up("corr", 8))


GRAM_COLS = ["n_orders", "num_suppliers", "week"]
GRAM_TERMS = ["1", *GRAM_COLS, "litres"]
CV_BLOCK = PANEL + """, placed AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, COUNT(*) OVER (PARTITION BY series) AS n FROM panel),
blocked AS (
  SELECT *, CAST(CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INTEGER) AS block
  FROM placed)"""
GRAM_SQL = " UNION ALL ".join(
    f"SELECT block, '{a}' AS a, '{b}' AS b, CAST(ROUND(CAST(SUM(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)) / 1e6 AS DECIMAL(38,8)), 4) AS DOUBLE) AS v FROM blocked GROUP BY block"
    for i, a in enumerate(GRAM_TERMS) for b in GRAM_TERMS[i:])


@query("agg_gram", f"""WITH {CV_BLOCK} {GRAM_SQL}""")
def agg_gram(spark, d):
    blocked = split_ts_cv(weekly_panel(spark, d), ["series"], "ts")
    return agg.agg_gram(blocked, GRAM_COLS, "litres", "block").withColumn("v", half_up(F.col("v") / 1e6, 4))


@query("agg_distinct_series", """SELECT DISTINCT event_type AS series FROM events""")
def agg_distinct_series(spark, d):
    return agg.agg_distinct_series(table(spark, d, "events").withColumnRenamed("event_type", "series"), ["series"])


@query("agg_hourly_readings", f"""WITH {HOURLY} SELECT series, ts, CAST(ROUND(CAST(value AS DECIMAL(38,10)), 6) AS DOUBLE) AS value, n FROM hourly""")
def agg_hourly_readings(spark, d):
    return hourly_readings(spark, d).withColumn("value", half_up("value", 6))
