"""Order, top rows, splits, reshaping and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import reshape, score, split
from tidemill.plans.catalog import half_up, query
from tidemill.plans.queries.aggregates import CV_BLOCK
from tidemill.plans.standins import (
    GAPS,
    NATIONS,
    PANEL,
    PRICES,
    gap_panel,
    monthly_prices,
    table,
    weekly_panel,
)

S, O = ["series"], "ts"


@query("sort_time", f"""WITH {GAPS} SELECT series, ts, litres FROM gaps ORDER BY ts NULLS LAST""")
def sort_time(spark, d):
    return split.sort_time(gap_panel(spark, d).select("series", "ts", "litres"), O)


@query("topk_recent", """SELECT event_id, ts, value FROM events WHERE value IS NOT NULL ORDER BY ts DESC LIMIT 100""")
def topk_recent(spark, d):
    known = table(spark, d, "events").select("event_id", "ts", "value").filter("value IS NOT NULL")
    return split.topk_recent(known, "ts", 100)


@query("topk_recent_series", """SELECT series, event_id, ts FROM (SELECT event_type AS series, event_id, ts,
ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 100""")
def topk_recent_series(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("series"), "event_id", "ts")
    return split.topk_recent(events, "ts", 100, S)


SCORED = ["n_orders", "num_suppliers", "top_price", "week"]
F_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, power(corr({f}, litres), 2) / (1 - power(corr({f}, litres), 2)) * (COUNT(*) - 2) AS score FROM panel"
    for f in SCORED)


@query("topk_features", f"""WITH {PANEL}, scores AS ({F_SQL})
SELECT feature, CAST(ROUND(CAST(score AS DECIMAL(38,8)), 4) AS DOUBLE) AS score FROM scores ORDER BY score DESC LIMIT 2""")
def topk_features(spark, d):
    scores = score.score_f(weekly_panel(spark, d), SCORED, "litres")
    return split.topk_features(scores, 2).withColumn("score", half_up("score", 4))


PLACED = PANEL + """, placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ts) AS rn,
  COUNT(*) OVER (PARTITION BY series) AS n FROM panel)"""


@query("split_tail", f"""WITH {PLACED}
SELECT series, ts, litres, rn > n - 52 AS is_test, CAST(CASE WHEN rn > n - 52 THEN rn - (n - 52) END AS INTEGER) AS horizon FROM placed""")
def split_tail(spark, d):
    return split.split_tail(weekly_panel(spark, d).select("series", "ts", "litres"), S, O, 52)


@query("split_exog", f"""WITH {PLACED}
SELECT series, ts, num_suppliers, n_orders, top_price, week, rn > n - 52 AS is_test,
  CAST(CASE WHEN rn > n - 52 THEN rn - (n - 52) END AS INTEGER) AS horizon FROM placed""")
def split_exog(spark, d):
    return split.split_exog(weekly_panel(spark, d), S, O, 52)


@query("split_ts_cv", f"""WITH {CV_BLOCK} SELECT series, ts, block FROM blocked""")
def split_ts_cv(spark, d):
    return split.split_ts_cv(weekly_panel(spark, d), S, O, 5).select("series", "ts", "block")


@query("split_ts_cv_raw", """WITH placed AS (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
  COUNT(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, CAST(CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INTEGER) AS block
FROM placed""")
def split_ts_cv_raw(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("series"), "ts", "event_id")
    return split.split_ts_cv(events, S, ["ts", "event_id"], 5, max_rows=1000).select("event_id", "block")


@query("head_slice", f"""WITH {PLACED} SELECT series, ts, litres FROM placed WHERE rn <= n - 17 AND rn <= 52""")
def head_slice(spark, d):
    return split.head_slice(weekly_panel(spark, d).select("series", "ts", "litres"), S, O, first=52, drop_last=17)


@query("reshape_unpivot", f"""WITH {PANEL}
SELECT series, ts, 'litres' AS name, litres AS value FROM panel
UNION ALL SELECT series, ts, 'top_price', top_price FROM panel""")
def reshape_unpivot(spark, d):
    return reshape.reshape_unpivot(weekly_panel(spark, d), ["series", "ts"], ["litres", "top_price"])


PIVOTED = ", ".join(f"MAX(price) FILTER (WHERE series = '{n}') AS \"{n}\"" for n in NATIONS)


@query("reshape_pivot", f"""WITH {PRICES} SELECT ts, {PIVOTED} FROM prices GROUP BY ts""")
def reshape_pivot(spark, d):
    return reshape.reshape_pivot(monthly_prices(spark, d), ["ts"], "series", NATIONS, F.max("price"))


@query("reshape_repeat_rows", f"""WITH {PRICES},
placed AS (SELECT series, ts, price, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ts) - 1 AS i FROM prices),
weeks AS (SELECT series, ts, price, i, unnest(range(1, CASE WHEN i % 3 = 0 THEN 6 ELSE 5 END)) AS k FROM placed),
counted AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY i, k) AS r FROM weeks)
SELECT series, ts, price, CAST((r + 3) % 52 + 1 AS INTEGER) AS week,
  CAST(year(ts) AS VARCHAR) || '_' || CAST((r + 3) % 52 + 1 AS VARCHAR) AS year_week FROM counted""")
def reshape_repeat_rows(spark, d):
    """Months to weeks, 5-4-4 by place in the series, with the wrapping week counter and its key."""
    from tidemill.functions.calendar import week_key

    weeks = reshape.month_to_weeks(monthly_prices(spark, d), S, O)
    return weeks.select("series", "ts", "price", "week", week_key("ts", "counter", "week").alias("year_week"))


@query("reshape_calendar", """WITH b AS (SELECT CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders)
SELECT series, CAST(unnest(generate_series(lo + CAST((8 - isodow(lo)) % 7 AS INTEGER), hi, INTERVAL 7 DAY)) AS DATE) AS ts
FROM (SELECT o_orderpriority AS series, CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi
      FROM orders GROUP BY o_orderpriority)""")
def reshape_calendar(spark, d):
    """Mondays from the first to the last order of each series."""
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("ts"))
    return reshape.series_grid(orders, S, O, "W-MON")


@query("reshape_asfreq", """WITH days AS (SELECT o_orderpriority || '/' || o_orderstatus AS series, CAST(o_orderdate AS DATE) AS ts,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS litres FROM orders GROUP BY ALL),
ends AS (SELECT series, MIN(ts) AS lo, MAX(ts) AS hi FROM days GROUP BY series),
sundays AS (SELECT series, CAST(unnest(generate_series(lo + CAST(7 - isodow(lo) AS INTEGER), hi, INTERVAL 7 DAY)) AS DATE) AS ts FROM ends),
found AS (SELECT s.series, s.ts, d.litres, ROW_NUMBER() OVER (PARTITION BY s.series, s.ts ORDER BY d.ts DESC) AS rn
  FROM sundays s JOIN days d ON d.series = s.series AND d.ts <= s.ts)
SELECT series, ts, litres FROM found WHERE rn = 1""")
def reshape_asfreq(spark, d):
    """Daily totals on a Sunday grid, each Sunday taking the last day at or before it."""
    days = table(spark, d, "orders").groupBy(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("series"), F.col("o_orderdate").cast("date").alias("ts"),
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("litres"))
    return reshape.reshape_asfreq(days, S, O)


@query("set_union_results", f"""WITH {PANEL}
SELECT 'a' AS model, series, ts, litres AS prediction, NULL AS lag FROM panel
UNION ALL SELECT 'b', series, ts, litres * 2, 3 FROM panel""")
def set_union_results(spark, d):
    panel = weekly_panel(spark, d)
    a = panel.select(F.lit("a").alias("model"), "series", "ts", F.col("litres").alias("prediction"))
    b = panel.select(F.lit("b").alias("model"), "series", "ts", (F.col("litres") * 2).alias("prediction"), F.lit(3).alias("lag"))
    return reshape.set_union_results([a, b])
