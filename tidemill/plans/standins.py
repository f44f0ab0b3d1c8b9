"""Inputs of the plans, derived from the given tables, each with the SQL that defines it.

Money is summed as decimal, so the panels do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.joins import join_calendar_left
from tidemill.operators.reshape import reshape_pivot, series_grid
from tidemill.session import ensure_utc

# The names the SQL definitions list; the frames take theirs from the table itself.
NATIONS = [f"NATION_{i}" for i in range(25)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def nation_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """All nations of the table: what a wide sheet has columns for."""
    return [r[0] for r in table(spark, sf_dir, "nation").select("n_name").distinct().orderBy("n_name").collect()]


def cents(col: str):
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly target panel: one series an order priority."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("series"), F.date_trunc("week", "o_orderdate").cast("date").alias("ts"),
    ).agg(
        cents("o_totalprice").alias("litres"),
        F.countDistinct("o_custkey").alias("num_suppliers"),
        F.count(F.lit(1)).alias("n_orders"),
        F.max("o_totalprice").alias("top_price"),
    ).withColumn("week", F.weekofyear("ts"))


PANEL = """panel AS (
  SELECT o_orderpriority AS series, CAST(date_trunc('week', o_orderdate) AS DATE) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS litres,
         CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS num_suppliers,
         CAST(COUNT(*) AS BIGINT) AS n_orders,
         MAX(o_totalprice) AS top_price,
         CAST(weekofyear(CAST(date_trunc('week', o_orderdate) AS DATE)) AS INTEGER) AS week
  FROM orders GROUP BY o_orderpriority, CAST(date_trunc('week', o_orderdate) AS DATE))"""


def gap_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly panel by priority and status on its full grid: weeks without orders hold nulls."""
    orders = table(spark, sf_dir, "orders")
    panel = orders.groupBy(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("series"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("ts"),
    ).agg(cents("o_totalprice").alias("litres"), F.count(F.lit(1)).alias("n_orders"))
    grid = series_grid(panel, ["series"], "ts", "W-MON")
    return join_calendar_left(grid, panel, ["series", "ts"])


GAPS = """sparse AS (
  SELECT o_orderpriority || '/' || o_orderstatus AS series, CAST(date_trunc('week', o_orderdate) AS DATE) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS litres, CAST(COUNT(*) AS BIGINT) AS n_orders
  FROM orders GROUP BY ALL),
grid AS (
  SELECT series, CAST(unnest(generate_series(MIN(ts), MAX(ts), INTERVAL 7 DAY)) AS DATE) AS ts
  FROM sparse GROUP BY series),
gaps AS (
  SELECT g.series, g.ts, p.litres, p.n_orders
  FROM grid g LEFT JOIN sparse p ON g.series = p.series AND g.ts = p.ts)"""


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order price by country, long form."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # The join only adds a short key; grouping by it leaves a row a nation and month in each task before the shuffle.
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    by_key = joined.groupBy("c_nationkey", F.date_trunc("month", "o_orderdate").cast("date").alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count(F.lit(1)).alias("n"))
    named = by_key.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("series"), "ts",
                        (F.col("total").cast("double") / F.col("n")).alias("price"))


PRICES = """prices AS (
  SELECT n_name AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, CAST(date_trunc('month', o_orderdate) AS DATE))"""


def price_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw sheet's form: text cells, months as rows, countries as columns, ``c`` for missing."""
    prices = monthly_prices(spark, sf_dir).withColumn("month", F.date_format("ts", "yyyy'M'MM"))
    nations = nation_names(spark, sf_dir)
    wide = reshape_pivot(prices, ["month"], "series", nations, F.first("price"))
    return wide.select("month", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("c")).alias(c) for c in nations])


def station_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily station means, long form: quantity as rain, discount as soil, tax as sun."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kinds = {"rain": "l_quantity", "soil": "l_discount", "sun": "l_tax"}
    joined = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    by_key = joined.groupBy("s_nationkey", F.col("l_shipdate").cast("date").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(18,2)")).alias(k) for k, c in kinds.items()])
    named = by_key.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("station"), "ts",
                        *[(F.col(k).cast("double") / F.col("n")).alias(k) for k in kinds])


WEATHER = """weather AS (
  SELECT n_name AS station, CAST(l_shipdate AS DATE) AS ts,
         CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS rain,
         CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS soil,
         CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS sun
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY n_name, CAST(l_shipdate AS DATE))"""


def weather_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day, columns ``<station>_rain``, ``_soil``, ``_sun``."""
    weather = station_weather(spark, sf_dir)
    wide = weather.groupBy("ts").pivot("station", nation_names(spark, sf_dir)).agg(
        F.first("rain").alias("rain"), F.first("soil").alias("soil"), F.first("sun").alias("sun"))
    return wide


def monthly_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two monthly lines: mean price of all orders, and of the finished ones."""
    orders = table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    price = F.col("o_totalprice").cast("decimal(18,2)")
    sums = orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("ts")).agg(
        F.sum(price).cast("double").alias("t"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(done, price)).cast("double").alias("td"), F.count_if(done).alias("nd"))
    return sums.select("ts", (F.col("t") / F.col("n")).alias("eu"), F.try_divide("td", "nd").alias("ireland"))


INFLATION = """inflation AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS eu,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE)
           / NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS ireland
  FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE))"""


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sensor series, one an event type; hours without events are absent."""
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return events.groupBy(F.col("event_type").alias("series"), hour).agg(
        (cents("value") / F.count(F.lit(1))).alias("value"), F.count(F.lit(1)).alias("n"))


HOURLY = """hourly AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS ts,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS value, CAST(COUNT(*) AS BIGINT) AS n
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""


def naive_pairs(spark: SparkSession, sf_dir: str, horizon: int = 52) -> DataFrame:
    """Actual and predicted test weeks of two simple models, per series and horizon."""
    from pyspark.sql import Window

    panel = weekly_panel(spark, sf_dir)
    w = Window.partitionBy("series").orderBy("ts")
    # The place from the end numbers the test weeks; both models look 52 rows and more back.
    from_end = F.count(F.lit(1)).over(Window.partitionBy("series")) - F.row_number().over(w)
    looked = panel.select("series", "ts", F.col("litres").alias("y_true"), from_end.alias("_e"),
                          F.lag("litres", horizon).over(w).alias("season"), F.lag("litres", horizon + 1).over(w).alias("shifted"))
    tail = looked.filter(F.col("_e") < horizon).withColumn("horizon", (horizon - F.col("_e")).cast("int"))
    models = F.array(F.struct(F.lit("season").alias("model"), F.col("season").alias("y_pred")),
                     F.struct(F.lit("shifted").alias("model"), F.col("shifted").alias("y_pred")))
    return tail.select("series", "ts", "horizon", "y_true", F.inline(models)).filter("y_pred IS NOT NULL")


PAIRS = PANEL + """, looked AS (
  SELECT series, ts, litres AS y_true,
         COUNT(*) OVER (PARTITION BY series) - ROW_NUMBER() OVER (PARTITION BY series ORDER BY ts) AS e,
         LAG(litres, 52) OVER (PARTITION BY series ORDER BY ts) AS season,
         LAG(litres, 53) OVER (PARTITION BY series ORDER BY ts) AS shifted
  FROM panel),
pairs AS (
  SELECT series, ts, CAST(52 - e AS INTEGER) AS horizon, y_true, 'season' AS model, season AS y_pred
  FROM looked WHERE e < 52 AND season IS NOT NULL
  UNION ALL
  SELECT series, ts, CAST(52 - e AS INTEGER), y_true, 'shifted', shifted
  FROM looked WHERE e < 52 AND shifted IS NOT NULL)"""
