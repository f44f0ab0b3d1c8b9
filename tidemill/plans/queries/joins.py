"""Joins on week keys, calendars, as-of times and horizons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.calendar import week_key
from tidemill.operators import joins
from tidemill.operators.timeseries import win_pct_change
from tidemill.plans.catalog import half_up, query
from tidemill.plans.standins import (
    HOURLY,
    PAIRS,
    PANEL,
    hourly_readings,
    naive_pairs,
    table,
    weekly_panel,
)
from tidemill.streaming.sensor import backfill_origins

DAY_KEYS = """
ords AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(weekofyear(o_orderdate) AS VARCHAR) AS year_week,
                CAST(o_orderdate AS DATE) AS order_day, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS price
         FROM orders GROUP BY ALL),
ships AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || '_' || CAST(weekofyear(l_shipdate) AS VARCHAR) AS year_week,
                 CAST(AVG(CAST(l_quantity AS INTEGER)) AS DOUBLE) AS quantity
          FROM lineitem GROUP BY ALL),
states AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(weekofyear(o_orderdate) AS VARCHAR) AS year_week,
                  o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ALL)"""


@query("join_week_inner", f"""WITH {DAY_KEYS}
SELECT o.year_week, o.order_day, CAST(o.price AS DOUBLE) AS price, CAST(ROUND(CAST(s.quantity AS DECIMAL(38,10)), 6) AS DOUBLE) AS quantity,
       t.o_orderstatus, t.n, p.suppliers
FROM ords o JOIN ships s USING (year_week) JOIN states t USING (year_week)
JOIN (SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(weekofyear(o_orderdate) AS VARCHAR) AS year_week,
             COUNT(DISTINCT o_custkey) AS suppliers FROM orders GROUP BY ALL) p USING (year_week)
JOIN (SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) || '_' || CAST(weekofyear(l_shipdate) AS VARCHAR) AS year_week
      FROM lineitem) i USING (year_week)""")
def join_week_inner(spark, d):
    """Five inputs on the colliding calendar-year key; weeks fan out to their days and states."""
    orders, lineitem = table(spark, d, "orders"), table(spark, d, "lineitem")
    by_order = week_key("o_orderdate", "calendar_iso").alias("year_week")
    by_ship = week_key("l_shipdate", "calendar_iso").alias("year_week")
    days = orders.groupBy(by_order, F.col("o_orderdate").cast("date").alias("order_day")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))
    ships = lineitem.groupBy(by_ship).agg(half_up(F.avg("l_quantity"), 6).alias("quantity"))
    states = orders.groupBy(by_order, "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    people = orders.groupBy(by_order).agg(F.countDistinct("o_custkey").alias("suppliers"))
    seen = lineitem.select(by_ship).distinct()
    return joins.join_week_inner([days, ships, states, people, seen])


@query("join_calendar_left", f"""WITH {PANEL},
cal AS (SELECT series, CAST(unnest(generate_series(DATE '1995-01-02', DATE '2001-12-31', INTERVAL 7 DAY)) AS DATE) AS ts
        FROM (SELECT DISTINCT series FROM panel))
SELECT cal.series, cal.ts, COALESCE(panel.litres, 0) AS litres FROM cal LEFT JOIN panel ON cal.series = panel.series AND cal.ts = panel.ts""")
def join_calendar_left(spark, d):
    panel = weekly_panel(spark, d).select("series", "ts", "litres")
    weeks = F.sequence(F.lit("1995-01-02").cast("date"), F.lit("2001-12-31").cast("date"), F.expr("interval 7 days"))
    cal = panel.select("series").distinct().select("series", F.explode(weeks).alias("ts"))
    return joins.join_calendar_left(cal, panel, ["series", "ts"], fill=0.0)


@query("join_week_outer", """WITH a AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(CAST(strftime(o_orderdate, '%W') AS INTEGER) AS VARCHAR) AS year_week, COUNT(*) AS orders_n
  FROM orders GROUP BY ALL),
b AS (SELECT CAST(year(l_shipdate) AS VARCHAR) || '_' || CAST(CAST(strftime(l_shipdate, '%W') AS INTEGER) AS VARCHAR) AS year_week, COUNT(*) AS lines_n
  FROM lineitem GROUP BY ALL)
SELECT year_week, orders_n, lines_n FROM a FULL JOIN b USING (year_week)""")
def join_week_outer(spark, d):
    a = table(spark, d, "orders").groupBy(week_key("o_orderdate", "monday").alias("year_week")).agg(
        F.count(F.lit(1)).alias("orders_n"))
    b = table(spark, d, "lineitem").groupBy(week_key("l_shipdate", "monday").alias("year_week")).agg(
        F.count(F.lit(1)).alias("lines_n"))
    return joins.join_week_outer(a, b)


@query("join_positional", f"""WITH {PANEL}
SELECT series, ts, litres, CAST(ROUND(CAST(litres / LAG(litres) OVER w - 1 AS DECIMAL(38,10)), 6) AS DOUBLE) AS change, num_suppliers / 1.0 AS sup
FROM panel WINDOW w AS (PARTITION BY series ORDER BY ts)""")
def join_positional(spark, d):
    """Columns put side by side come from one ``select`` over the aligned rows; nothing is joined."""
    changed = win_pct_change(weekly_panel(spark, d), ["series"], "ts", "litres", "change")
    return changed.select("series", "ts", "litres", half_up("change", 6).alias("change"),
                          F.col("num_suppliers").cast("double").alias("sup"))


@query("join_align_reindex", f"""WITH {PAIRS},
f AS (SELECT series, ts, y_pred FROM pairs WHERE model = 'season')
SELECT f.series, f.ts, f.y_pred, p.litres, CAST(0 AS DOUBLE) AS missing
FROM f LEFT JOIN panel p ON f.series = p.series AND f.ts = p.ts""")
def join_align_reindex(spark, d):
    forecast = naive_pairs(spark, d).filter("model = 'season'").select("series", "ts", "y_pred")
    actual = weekly_panel(spark, d).select("series", "ts", "litres")
    aligned = joins.join_align(forecast, actual, ["series", "ts"])
    return joins.reindex_columns(aligned, ["series", "ts", "y_pred", "litres", "missing"])


BACKFILL = HOURLY + """, ends AS (SELECT series, MIN(ts) + INTERVAL 100 HOUR AS lo, MAX(ts) AS hi FROM hourly GROUP BY series),
origins AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 24 HOUR)) AS origin FROM ends),
seen AS (
  SELECT o.series, o.origin, h.ts, h.value,
         ROW_NUMBER() OVER (PARTITION BY o.series, o.origin ORDER BY h.ts DESC) AS rn
  FROM origins o JOIN hourly h ON h.series = o.series AND h.ts <= o.origin)"""


@query("join_asof_last_n", f"""WITH {BACKFILL}
SELECT series, origin, MAX(ts) AS last_ts, CAST(ROUND(CAST(MAX(value) FILTER (WHERE rn = 1) AS DECIMAL(38,10)), 6) AS DOUBLE) AS newest,
       CAST(ROUND(CAST(MAX(value) FILTER (WHERE rn = 100) AS DECIMAL(38,10)), 6) AS DOUBLE) AS oldest, CAST(ROUND(CAST(SUM(value * rn) FILTER (WHERE rn <= 100) AS DECIMAL(38,8)), 4) AS DOUBLE) AS weighted
FROM seen GROUP BY series, origin HAVING COUNT(*) >= 100""")
def join_asof_last_n(spark, d):
    readings = hourly_readings(spark, d)
    origins = backfill_origins(readings, ["series"], "ts")
    vectors = joins.join_asof_last_n(origins, readings, ["series"], "ts", "value", 100)
    h = F.col("history")
    places = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.get(h, i - 1) * i)
    return vectors.select("series", "origin", "last_ts", half_up(h[0], 6).alias("newest"), half_up(h[99], 6).alias("oldest"),
                          half_up(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 4).alias("weighted"))


@query("join_asof_last_n_raw", """WITH ends AS (
  SELECT event_type AS series, MIN(date_trunc('hour', ts)) + INTERVAL 100 HOUR AS lo, MAX(ts) AS hi FROM events GROUP BY event_type),
origins AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 24 HOUR)) AS origin FROM ends),
seen AS (SELECT o.series, o.origin, e.ts, e.value,
    ROW_NUMBER() OVER (PARTITION BY o.series, o.origin ORDER BY e.ts DESC) AS rn
  FROM origins o JOIN events e ON e.event_type = o.series AND e.ts <= o.origin)
SELECT series, origin, MAX(ts) AS last_ts, CAST(ROUND(CAST(SUM(value * rn) FILTER (WHERE rn <= 20) AS DECIMAL(38,8)), 4) AS DOUBLE) AS weighted
FROM seen GROUP BY series, origin HAVING COUNT(*) >= 20""")
def join_asof_last_n_raw(spark, d):
    """Raw readings, where a series has no bound: long series are cut into pieces of time."""
    raw = table(spark, d, "events").select(F.col("event_type").alias("series"), "ts", "value")
    ends = raw.groupBy("series").agg(F.min(F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("lo"), F.max("ts").alias("hi"))
    start = F.col("lo") + F.expr("interval 100 hours")
    origins = ends.select("series", F.explode(F.when(start <= F.col("hi"), F.sequence(
        start, F.col("hi"), F.expr("interval 24 hours")))).alias("origin"))
    vectors = joins.join_asof_last_n(origins, raw, ["series"], "ts", "value", 20, max_rows=1000)
    places = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.get("history", i - 1) * i)
    return vectors.select("series", "origin", "last_ts",
                          half_up(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 4).alias("weighted"))


@query("join_actual_pred", f"""WITH {PAIRS}
SELECT series, model, horizon, y_true, y_pred FROM pairs""")
def join_actual_pred(spark, d):
    """Predictions arrive as arrays per series and model (52 values at most) and meet the actuals by horizon."""
    pairs = naive_pairs(spark, d)
    arrays = pairs.groupBy("series", "model").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("horizon", "y_pred"))), lambda e: e["y_pred"]).alias("predictions"),
        F.min("horizon").alias("first"))
    pred = joins.explode_predictions(arrays).withColumn("horizon", F.col("horizon") + F.col("first") - 1).drop("first")
    actual = pairs.select("series", "horizon", "y_true").distinct()
    return joins.join_actual_pred(actual, pred, ["series"]).select("series", "model", "horizon", "y_true", "y_pred")
