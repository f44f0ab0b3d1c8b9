"""Row-level functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import calendar as cal
from tidemill.functions import scalars as sc
from tidemill.plans.catalog import half_up, query
from tidemill.plans.standins import GAPS, NATIONS, PAIRS, PANEL, PRICES, gap_panel, naive_pairs, price_sheet, table, weekly_panel

DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"


def days(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


@query("fn_parse_month", """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a,
CAST(date_trunc('month', o_orderdate) AS DATE) AS b, CAST(date_trunc('month', o_orderdate) AS DATE) AS c,
CAST(o_orderdate AS DATE) AS d, CAST(NULL AS DATE) AS bad FROM orders""")
def fn_parse_month(spark, d):
    text = table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy'M'MM").alias("a"), F.date_format("o_orderdate", "yyyy-MM").alias("b"),
        F.date_format("o_orderdate", "yyyyMM").alias("c"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return text.select("o_orderkey", cal.parse_month("a", "%Ym%m").alias("a"), cal.parse_month("b", "%Y-%m").alias("b"),
                       cal.parse_month("c", "%Y%m").alias("c"), cal.parse_month("d", "%Y-%m-%d").alias("d"),
                       cal.parse_month("d", "%Ym%m").alias("bad"))


@query("fn_format_month", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders""")
def fn_format_month(spark, d):
    return table(spark, d, "orders").select("o_orderkey", cal.format_month("o_orderdate").alias("month"))


@query("fn_week_key", f"""WITH {DAYS}
SELECT day, strftime(day, '%G') || '_' || CAST(weekofyear(day) AS VARCHAR) AS iso_key,
  CAST(year(day) AS VARCHAR) || '_' || CAST(weekofyear(day) AS VARCHAR) AS calendar_key,
  CAST(year(day) AS VARCHAR) || '_' || CAST(CAST(strftime(day, '%W') AS INTEGER) AS VARCHAR) AS monday_key,
  CAST(year(day) AS VARCHAR) || '_' || CAST((dayofyear(day) - 1) // 7 + 1 AS VARCHAR) AS counter_key FROM days""")
def fn_week_key(spark, d):
    counter = F.floor((F.dayofyear("day") - 1) / 7) + 1
    return days(spark, d).select(
        "day", cal.week_key("day", "iso_year").alias("iso_key"), cal.week_key("day", "calendar_iso").alias("calendar_key"),
        cal.week_key("day", "monday").alias("monday_key"), cal.week_key("day", "counter", counter).alias("counter_key"))


@query("fn_iso_week", f"""WITH {DAYS}
SELECT day, CAST(weekofyear(day) AS INTEGER) AS week, CAST(isoyear(day) AS INTEGER) AS year FROM days""")
def fn_iso_week(spark, d):
    return days(spark, d).select("day", cal.iso_week("day").alias("week"), cal.iso_year("day").alias("year"))


@query("fn_monday_week", f"""WITH {DAYS} SELECT day, CAST(strftime(day, '%W') AS INTEGER) AS week FROM days""")
def fn_monday_week(spark, d):
    return days(spark, d).select("day", cal.monday_week("day").alias("week"))


@query("fn_replace_year", f"""WITH {DAYS}
SELECT day, TRY_CAST('2013' || strftime(day, '-%m-%d') AS DATE) AS common, TRY_CAST('2016' || strftime(day, '-%m-%d') AS DATE) AS leap FROM days""")
def fn_replace_year(spark, d):
    return days(spark, d).select("day", cal.replace_year("day", 2013).alias("common"), cal.replace_year("day", 2016).alias("leap"))


@query("udf_element", f"""WITH {DAYS}, y AS (SELECT day, unnest(range(2013, 2025)) AS year FROM days)
SELECT day, CAST(year AS INTEGER) AS year, TRY_CAST(CAST(year AS VARCHAR) || strftime(day, '-%m-%d') AS DATE) AS moved FROM y""")
def udf_element(spark, d):
    """Per-element user function as a native expression: every day moved to each of twelve years."""
    years = days(spark, d).withColumn("year", F.explode(F.sequence(F.lit(2013), F.lit(2024))))
    return years.select("day", "year", cal.replace_year("day", F.col("year")).alias("moved"))


@query("fn_yearmonth_split", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
CAST(make_date(year(o_orderdate), month(o_orderdate), 1) + CAST((o_orderkey % 5) * 7 AS INTEGER) AS DATE) AS day,
CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS year_week FROM orders""")
def fn_yearmonth_split(spark, d):
    raw = table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMM").cast("int").alias("year_month"),
        (F.col("o_orderkey") % 5 + 1).alias("week"))
    year, month = cal.yearmonth_parts("year_month")
    return raw.select("o_orderkey", year.alias("year"), month.alias("month"),
                      cal.yearmonth_date("year_month", "week").alias("day"),
                      F.concat_ws("_", year.cast("string"), F.col("week").cast("string")).alias("year_week"))


@query("fn_calendar_features", """SELECT event_id, CAST(isodow(ts + INTERVAL 1 DAY) - 1 AS INTEGER) AS day_of_week,
CAST(dayofyear(ts + INTERVAL 1 DAY) AS INTEGER) AS day_of_year, CAST(weekofyear(ts + INTERVAL 1 DAY) AS INTEGER) AS week_of_year FROM events""")
def fn_calendar_features(spark, d):
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in cal.calendar_features("ts").items()])


@query("fn_epoch_ms", """SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('millisecond', ts) AS back,
epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 1000 AS day_ms FROM events""")
def fn_epoch_ms(spark, d):
    events = table(spark, d, "events").select("event_id", cal.to_epoch_ms("ts").alias("ms"), F.date_format("ts", "yyyy/MM/dd").alias("text"))
    return events.select("event_id", "ms", cal.from_epoch_ms("ms").cast("timestamp_ntz").alias("back"),
                         cal.date_text_to_ms("text").alias("day_ms"))


@query("fn_time_shift", """SELECT event_id, ts + INTERVAL 24 HOUR AS next_day, ts - INTERVAL 100 HOUR AS overlap,
ts + INTERVAL 7 DAY AS next_week FROM events""")
def fn_time_shift(spark, d):
    return table(spark, d, "events").select("event_id", cal.shift_time("ts", hours=24).alias("next_day"),
                                            cal.shift_time("ts", hours=-100).alias("overlap"),
                                            cal.shift_time("ts", days=7).alias("next_week"))


@query("fn_ratio", f"""WITH {PANEL}
SELECT series, ts, CAST(ROUND(CAST(litres / NULLIF(num_suppliers, 0) AS DECIMAL(38,8)), 4) AS DOUBLE) AS yield_per_supplier,
  CAST(NULL AS DOUBLE) AS by_zero FROM panel""")
def fn_ratio(spark, d):
    return weekly_panel(spark, d).select("series", "ts", half_up(sc.ratio("litres", "num_suppliers"), 4).alias("yield_per_supplier"),
                                         sc.ratio("litres", F.col("num_suppliers") * 0).alias("by_zero"))


@query("fn_seasonal_cos", f"""WITH {PANEL} SELECT series, ts, ROUND(cos(week * (2 * pi() / 52)), 8) AS cos_week FROM panel""")
def fn_seasonal_cos(spark, d):
    return weekly_panel(spark, d).select("series", "ts", F.round(sc.seasonal_cos("week"), 8).alias("cos_week"))


@query("fn_strip_suffix", f"""WITH {PRICES} SELECT series, ts, price FROM prices""")
def fn_strip_suffix(spark, d):
    """Series names from the wide sheet's column names."""
    from tidemill.operators.clean import proj_rename
    from tidemill.operators.reshape import reshape_pivot, reshape_unpivot
    from tidemill.plans.standins import monthly_prices

    wide = reshape_pivot(monthly_prices(spark, d), ["ts"], "series", NATIONS, F.max("price"))
    named = proj_rename(wide, suffix="_Milk_Price", keys=["ts"])
    long = reshape_unpivot(named, ["ts"], [f"{n}_Milk_Price" for n in NATIONS], "name", "price")
    return long.filter("price IS NOT NULL").select(sc.strip_suffix("name", "_Milk_Price").alias("series"), "ts", "price")


@query("fn_sentinel_null", f"""WITH {PRICES}, months AS (SELECT DISTINCT ts FROM prices)
SELECT strftime(m.ts, '%YM%m') AS month, p.price FROM months m LEFT JOIN prices p ON p.ts = m.ts AND p.series = 'NATION_7' """)
def fn_sentinel_null(spark, d):
    return price_sheet(spark, d).select("month", sc.number_or_null("NATION_7").alias("price"))


@query("fn_coalesce_zero", f"""WITH {GAPS} SELECT series, ts, COALESCE(litres, 0) AS litres FROM gaps""")
def fn_coalesce_zero(spark, d):
    return gap_panel(spark, d).select("series", "ts", sc.coalesce_zero("litres").alias("litres"))


@query("fn_ape", f"""WITH {PAIRS}
SELECT series, model, horizon, CAST(ROUND(CAST(abs((y_true - y_pred) / NULLIF(y_true, 0)) * 100 AS DECIMAL(38,10)), 6) AS DOUBLE) AS ape FROM pairs""")
def fn_ape(spark, d):
    return naive_pairs(spark, d).select("series", "model", "horizon", half_up(sc.ape("y_true", "y_pred"), 6).alias("ape"))


@query("fn_abs_sqrt_pow", f"""WITH {PAIRS}
SELECT series, model, horizon, CAST(ROUND(CAST(abs(y_true - y_pred) AS DECIMAL(38,7)), 3) AS DOUBLE) AS err,
  CAST(ROUND(CAST(sqrt(abs(y_true - y_pred)) AS DECIMAL(38,10)), 6) AS DOUBLE) AS root,
  CAST(ROUND(CAST((y_true - y_pred) * (y_true - y_pred) / 1e6 AS DECIMAL(38,7)), 3) AS DOUBLE) AS square FROM pairs""")
def fn_abs_sqrt_pow(spark, d):
    err = sc.abs_error("y_true", "y_pred")
    return naive_pairs(spark, d).select("series", "model", "horizon", half_up(err, 3).alias("err"), half_up(F.sqrt(err), 6).alias("root"),
                                        half_up(sc.squared_error("y_true", "y_pred") / 1e6, 3).alias("square"))
