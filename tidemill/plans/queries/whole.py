"""Whole plans: the feature panel and the weekly dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators.timeseries import win_lag_features
from tidemill.plans import dataset
from tidemill.plans.catalog import half_up, half_up_sql, query
from tidemill.plans.forecast import new_features, preprocess
from tidemill.plans.standins import INFLATION, PANEL, WEATHER, monthly_inflation, price_sheet, table, weather_wide, weekly_panel
from tidemill.settings import Settings

S, O = ["series"], "ts"
LAGGED = ["num_suppliers", "yield_per_supplier", "cos_week", "past_values"]
DIGITS = {"yield_per_supplier": 3, "cos_week": 8, "past_values": 3, "num_suppliers": 3}


def _lag_cells(c: str) -> str:
    return ", ".join(f'{half_up_sql(f"LAG({c}, {i}) OVER w", DIGITS[c])} AS "{c}-{i}"' for i in (1, 2, 3))


@query("weekly_feature_panel", f"""WITH {PANEL}, f AS (SELECT series, ts, litres, num_suppliers, week,
  litres / num_suppliers AS yield_per_supplier, cos(week * (2 * pi() / 52)) AS cos_week,
  AVG(litres) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS past_values FROM panel),
l AS (SELECT series, ts, litres, num_suppliers, CAST(week AS INTEGER) AS "Week", {", ".join(
    f"{half_up_sql(c, DIGITS[c])} AS {c}" for c in ("yield_per_supplier", "cos_week", "past_values"))},
  {", ".join(_lag_cells(c) for c in LAGGED)} FROM f WINDOW w AS (PARTITION BY series ORDER BY ts))
SELECT * FROM l WHERE "past_values-3" IS NOT NULL""")
def weekly_feature_panel(spark, d):
    """Ratio, seasonal cosine, running mean and three lags of every feature."""
    panel = weekly_panel(spark, d).select("series", "ts", "litres", "num_suppliers", F.col("week").alias("Week"))
    featured = new_features(panel, S, O, "litres", Settings())
    lagged = win_lag_features(featured, S, O, LAGGED, 3)
    rounded = {c: half_up(c, DIGITS[c.split("-")[0]]) for c in lagged.columns if c.split("-")[0] in LAGGED and c != "num_suppliers"}
    return lagged.select(*[rounded[c].alias(c) if c in rounded else F.col(c) for c in lagged.columns])


@query("preprocess_lag")
def preprocess_lag(spark, d):
    """The full preparation of one lag: imputation, smoothing, features, lags."""
    panel = weekly_panel(spark, d).withColumnRenamed("week", "Week")
    out = preprocess(panel, S, O, "litres", 2, Settings())
    return out.select(*[half_up(f.name, 3).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`")
                        for f in out.schema.fields])


YEARS = list(range(1995, 2002))
KEEP = ["NATION_0_Milk_Price", "NATION_7_Milk_Price", "Grass_growth", "litres", "num_suppliers", "mean_rain", "mean_soil", "mean_sun",
        "Ire_inflation_rate", "EU_inflation_rate"]


def grass_sheet(spark, d):
    """Rows are the days of a leap year, columns the years; cells the mean tax of the day's lines."""
    days = table(spark, d, "lineitem").groupBy(
        F.make_date(F.lit(2000), F.month("l_shipdate"), F.dayofmonth("l_shipdate")).alias("Date"), F.year("l_shipdate").alias("year"),
    ).agg((F.sum(F.col("l_tax").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("growth"))
    return days.groupBy("Date").pivot("year", YEARS).agg(F.first("growth"))


def yield_file(spark, d):
    week = F.least(F.floor((F.dayofyear("o_orderdate") - 1) / 7) + 1, F.lit(52)).cast("int")
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), week.alias("week")).agg(
        F.min(F.date_format("o_orderdate", "yyyyMM").cast("int")).alias("year_month"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("litres"),
        F.countDistinct("o_custkey").alias("num_suppliers"))


DATASET = f"""{WEATHER}, {INFLATION},
prices AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE n_name = 'NATION_0') AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE n_name = 'NATION_0'), 0) AS p0,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE n_name = 'NATION_7') AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE n_name = 'NATION_7'), 0) AS p7
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
months AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ts) - 1 AS i FROM prices
  WHERE strftime(ts, '%Y-%m') >= '1995-01-01' AND strftime(ts, '%Y-%m') <= '2001-12-31'),
weeks AS (SELECT *, unnest(range(1, CASE WHEN i % 3 = 0 THEN 6 ELSE 5 END)) AS k FROM months),
price_w AS (SELECT CAST(year(ts) AS VARCHAR) || '_' || CAST((ROW_NUMBER() OVER (ORDER BY i, k) + 3) % 52 + 1 AS VARCHAR) AS year_week, p0, p7 FROM weeks),
grass_days AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS growth FROM lineitem GROUP BY 1),
grass_full AS (SELECT CAST(make_date(y.y, month(g.dd), day(g.dd)) AS DATE) AS day FROM (SELECT DISTINCT make_date(2000, month(day), day(day)) AS dd FROM grass_days) g,
  range(1995, 2002) y(y) WHERE NOT (month(g.dd) = 2 AND day(g.dd) = 29 AND y.y NOT IN (1996, 2000))),
grass_r AS (SELECT CAST(year(f.day) AS VARCHAR) || '_' || CAST(CAST(strftime(f.day, '%W') AS INTEGER) AS VARCHAR) AS year_week, g.growth
  FROM grass_full f LEFT JOIN grass_days g ON g.day = f.day),
cal AS (SELECT CAST(unnest(generate_series(DATE '1995-01-02', DATE '2001-12-31', INTERVAL 7 DAY)) AS DATE) AS day),
cal_w AS (SELECT day, CAST(year(day) AS VARCHAR) || '_' || CAST(CAST(strftime(day, '%W') AS INTEGER) AS VARCHAR) AS year_week FROM cal),
grass_m AS (SELECT c.day AS "Date", year_week, CAST(split_part(year_week, '_', 2) AS INTEGER) AS week, r.growth
  FROM cal_w c FULL JOIN grass_r r USING (year_week)),
grass_w AS (SELECT "Date", year_week, COALESCE(growth, AVG(growth) OVER (PARTITION BY week)) AS growth FROM grass_m),
yield_w AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(least((dayofyear(o_orderdate) - 1) // 7 + 1, 52) AS VARCHAR) AS year_week,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS litres, COUNT(DISTINCT o_custkey) AS num_suppliers FROM orders GROUP BY 1),
day_means AS (SELECT ts, AVG(rain) AS r, AVG(soil) AS s, AVG(sun) AS u FROM weather WHERE ts BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY ts),
weather_k AS (SELECT CAST(year(ts) AS VARCHAR) || '_' || CAST(weekofyear(ts) AS VARCHAR) AS year_week, AVG(r) AS r, AVG(s) AS s, AVG(u) AS u FROM day_means GROUP BY 1),
weather_w AS (SELECT c.year_week, COALESCE(r, 0) AS r, COALESCE(s, 0) AS s, COALESCE(u, 0) AS u
  FROM (SELECT CAST(year(day) AS VARCHAR) || '_' || CAST(weekofyear(day) AS VARCHAR) AS year_week FROM cal) c LEFT JOIN weather_k USING (year_week)),
ends AS (SELECT MIN(ts) + CAST((8 - isodow(MIN(ts))) % 7 AS INTEGER) AS lo, MAX(ts) + CAST((8 - isodow(MAX(ts))) % 7 AS INTEGER) AS hi FROM inflation),
infl_pts AS (SELECT m.ts, i.eu, i.ireland FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS ts FROM ends) m LEFT JOIN inflation i USING (ts)),
infl_near AS (SELECT ts, {", ".join(f'''{c},
    LAST_VALUE(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS {c}_pt, LAST_VALUE({c} IGNORE NULLS) OVER b AS {c}_pv,
    FIRST_VALUE(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS {c}_nt, FIRST_VALUE({c} IGNORE NULLS) OVER a AS {c}_nv''' for c in ("eu", "ireland"))}
  FROM infl_pts WINDOW b AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
infl_w AS (SELECT CAST(year(ts) AS VARCHAR) || '_' || CAST(weekofyear(ts) AS VARCHAR) AS year_week, {", ".join(f'''
    CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_nt IS NULL THEN {c}_pv WHEN {c}_pt IS NULL THEN NULL
      ELSE {c}_pv + ({c}_nv - {c}_pv) * CAST(ts - {c}_pt AS DOUBLE) / CAST({c}_nt - {c}_pt AS DOUBLE) END AS {c}''' for c in ("eu", "ireland"))}
  FROM infl_near WHERE ts BETWEEN DATE '1995-01-01' AND DATE '2001-12-31')"""


def stages(spark, d):
    lo, hi = "1995-01-01", "2001-12-31"
    prices = dataset.price_stage(price_sheet(spark, d), "month", lo, hi)
    grass = dataset.grass_stage(grass_sheet(spark, d), YEARS, lo, hi).drop("Week")
    yields = dataset.yield_stage(yield_file(spark, d))
    weather = dataset.weather_stage(weather_wide(spark, d).withColumnRenamed("ts", "Date"), lo, hi)
    inflation = dataset.inflation_stage(monthly_inflation(spark, d).withColumnRenamed("ts", "Date"),
                                        {"ireland": "Ire_inflation_rate", "eu": "EU_inflation_rate"}, lo, hi)
    return prices, grass, yields, weather, inflation


CELLS = {"NATION_0_Milk_Price": ("p0", 3), "NATION_7_Milk_Price": ("p7", 3), "Grass_growth": ("growth", 8), "litres": ("litres", 2),
         "mean_rain": ("r", 6), "mean_soil": ("s", 8), "mean_sun": ("u", 8), "Ire_inflation_rate": ("ireland", 3),
         "EU_inflation_rate": ("eu", 3)}


@query("weekly_dataset", f"""WITH {DATASET}
SELECT "Date", year_week, num_suppliers, {", ".join(f'{half_up_sql(e, k)} AS "{n}"' for n, (e, k) in CELLS.items())}
FROM price_w JOIN grass_w USING (year_week) JOIN yield_w USING (year_week) JOIN weather_w USING (year_week) JOIN infl_w USING (year_week)""")
def weekly_dataset(spark, d):
    """Five sources to one weekly table, with the m:n fan-out of keys that are not unique."""
    out = dataset.final_stage(*stages(spark, d), keep=KEEP)
    return out.select(*[half_up(c, CELLS[c][1]).alias(c) if c in CELLS else F.col(c) for c in out.columns])


@query("cfg_actions")
def cfg_actions(spark, d):
    """Stage switches: without smoothing and lags, with multi-step targets."""
    settings = Settings(smoothing=False, shifting=False, multi_step=True, forecast_weeks=4)
    panel = weekly_panel(spark, d).withColumnRenamed("week", "Week")
    out = preprocess(panel, S, O, "litres", 1, settings)
    return out.select("series", "ts", "litres", *[f"litres_step_{i}" for i in range(1, 5)])
