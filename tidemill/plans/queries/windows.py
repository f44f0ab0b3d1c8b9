"""Windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import timeseries as ts
from tidemill.operators.layout import fill_forward
from tidemill.plans.catalog import half_up, query
from tidemill.plans.standins import (
    GAPS,
    HOURLY,
    INFLATION,
    PANEL,
    PRICES,
    gap_panel,
    hourly_readings,
    monthly_inflation,
    monthly_prices,
    table,
    weekly_panel,
)

S, O = ["series"], "ts"
W = "WINDOW w AS (PARTITION BY series ORDER BY ts)"


def rounded(df, digits, *cols):
    return df.withColumns({c: half_up(c, digits) for c in cols})


def raw_events(spark, d):
    """Raw readings: no grid bounds the length of a series, so operators get ``max_rows``."""
    return table(spark, d, "events").select(F.col("event_type").alias("series"), "ts", "event_id", "value")


@query("win_lag_features", f"""WITH {PANEL}, lagged AS (
SELECT series, ts, litres, num_suppliers, n_orders,
  LAG(num_suppliers, 1) OVER w AS "num_suppliers-1", LAG(num_suppliers, 2) OVER w AS "num_suppliers-2",
  LAG(num_suppliers, 3) OVER w AS "num_suppliers-3", LAG(n_orders, 1) OVER w AS "n_orders-1",
  LAG(n_orders, 2) OVER w AS "n_orders-2", LAG(n_orders, 3) OVER w AS "n_orders-3" FROM panel {W})
SELECT * FROM lagged WHERE "n_orders-3" IS NOT NULL""")
def win_lag_features(spark, d):
    panel = weekly_panel(spark, d).select("series", "ts", "litres", "num_suppliers", "n_orders")
    return ts.win_lag_features(panel, S, O, ["num_suppliers", "n_orders"], 3)


@query("win_lag_features_keep", f"""WITH {GAPS}
SELECT series, ts, litres, LAG(litres, 1) OVER w AS "litres-1", LAG(litres, 2) OVER w AS "litres-2" FROM gaps {W}""")
def win_lag_features_keep(spark, d):
    """The older form, which keeps rows with nulls."""
    return ts.win_lag_features(gap_panel(spark, d).select("series", "ts", "litres"), S, O, ["litres"], 2, dropna=False)


@query("win_lag_features_raw", f"""SELECT event_type AS series, ts, event_id, value, LAG(value, 1) OVER w AS "value-1",
LAG(value, 7) OVER w AS "value-7" FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def win_lag_features_raw(spark, d):
    lagged = ts.win_lag_features(raw_events(spark, d), S, ["ts", "event_id"], ["value"], 7, dropna=False, max_rows=1000)
    return lagged.select("series", "ts", "event_id", "value", "`value-1`", "`value-7`")


@query("win_multistep", f"""WITH {PANEL}, led AS (
SELECT series, ts, litres, LEAD(litres, 1) OVER w AS litres_step_1, LEAD(litres, 2) OVER w AS litres_step_2,
  LEAD(litres, 3) OVER w AS litres_step_3, LEAD(litres, 4) OVER w AS litres_step_4 FROM panel {W})
SELECT * FROM led WHERE litres_step_4 IS NOT NULL""")
def win_multistep(spark, d):
    return ts.win_multistep(weekly_panel(spark, d).select("series", "ts", "litres"), S, O, "litres", 4)


@query("win_expanding_mean", f"""WITH {PANEL}
SELECT series, ts, CAST(ROUND(CAST(AVG(litres) OVER (w ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,7)), 3) AS DOUBLE) AS past_values FROM panel {W}""")
def win_expanding_mean(spark, d):
    out = ts.win_expanding_mean(weekly_panel(spark, d).select("series", "ts", "litres"), S, O, "litres")
    return rounded(out, 3, "past_values").select("series", "ts", "past_values")


@query("win_expanding_mean_past", f"""WITH {GAPS}
SELECT series, ts, CAST(ROUND(CAST(AVG(litres) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DECIMAL(38,7)), 3) AS DOUBLE) AS past_values FROM gaps {W}""")
def win_expanding_mean_past(spark, d):
    """The form without the current value, over series with gaps."""
    out = ts.win_expanding_mean(gap_panel(spark, d), S, O, "litres", include_current=False)
    return rounded(out, 3, "past_values").select("series", "ts", "past_values")


@query("win_expanding_mean_raw", """SELECT event_id, CAST(ROUND(CAST(AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,9)), 5) AS DOUBLE) AS past_values FROM events""")
def win_expanding_mean_raw(spark, d):
    out = ts.win_expanding_mean(raw_events(spark, d), S, ["ts", "event_id"], "value", max_rows=1000)
    return rounded(out, 5, "past_values").select("event_id", "past_values")


@query("win_ma", f"""WITH {GAPS}
SELECT series, ts, CAST(ROUND(CAST(AVG(litres) OVER (w ROWS 4 PRECEDING) AS DECIMAL(38,7)), 3) AS DOUBLE) AS "litres_MA" FROM gaps {W}""")
def win_ma(spark, d):
    return rounded(ts.win_ma(gap_panel(spark, d).select("series", "ts", "litres"), S, O, ["litres"], 5), 3, "litres_MA").drop("litres")


@query("win_ma_raw", """SELECT event_id, CAST(ROUND(CAST(AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 23 PRECEDING) AS DECIMAL(38,9)), 5) AS DOUBLE)
AS "value_MA" FROM events""")
def win_ma_raw(spark, d):
    out = ts.win_ma(raw_events(spark, d), S, ["ts", "event_id"], ["value"], 24, max_rows=1000)
    return rounded(out, 5, "value_MA").select("event_id", "value_MA")


WMA_SUM = " + ".join(f"{j} * LAG(litres, {20 - j}) OVER w" for j in range(1, 21))


@query("win_wma", f"""WITH {PANEL}, m AS (SELECT series, ts, ({WMA_SUM}) / 210.0 AS v FROM panel {W})
SELECT series, ts, CAST(ROUND(CAST(v AS DECIMAL(38,7)), 3) AS DOUBLE) AS "litres_WMA" FROM m WHERE v IS NOT NULL""")
def win_wma(spark, d):
    out = ts.win_wma(weekly_panel(spark, d).select("series", "ts", "litres"), S, O, ["litres"], 20)
    return rounded(out, 3, "litres_WMA").drop("litres")


def ewm_sql(source: str, span: int) -> str:
    """Weights by place, over all earlier rows of the series."""
    keep = 1 - 2 / (span + 1)
    return f"""placed AS (SELECT series, ts, litres, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ts) AS pos FROM {source}),
ewm AS (SELECT a.series, a.ts, a.pos, SUM(b.litres * power({keep!r}, a.pos - b.pos))
          / SUM(CASE WHEN b.litres IS NOT NULL THEN power({keep!r}, a.pos - b.pos) END) AS v
        FROM placed a JOIN placed b ON a.series = b.series AND b.pos <= a.pos
        GROUP BY a.series, a.ts, a.pos)"""


@query("win_ewm", f"""WITH {GAPS}, {ewm_sql("gaps", 5)} SELECT series, ts, CAST(ROUND(CAST(v AS DECIMAL(38,7)), 3) AS DOUBLE) AS "litres_EW" FROM ewm""")
def win_ewm(spark, d):
    out = ts.win_ewm(gap_panel(spark, d).select("series", "ts", "litres"), S, O, ["litres"], 5)
    return rounded(out, 3, "litres_EW").drop("litres")


# Three years without a value: longer than any row's weight lasts in a frame of fixed reach.
LONG_GAP = "ts >= TIMESTAMP '1994-01-01' AND ts < TIMESTAMP '1997-01-01'"


@query("win_ewm_gaps", f"""WITH {PANEL}, holes AS (SELECT series, ts, CASE WHEN {LONG_GAP} THEN NULL ELSE litres END AS litres FROM panel),
{ewm_sql("holes", 5)} SELECT series, ts, CAST(ROUND(CAST(v AS DECIMAL(38,7)), 3) AS DOUBLE) AS "litres_EW" FROM ewm""")
def win_ewm_gaps(spark, d):
    panel = weekly_panel(spark, d).select("series", "ts", F.when(~F.expr(LONG_GAP), F.col("litres")).alias("litres"))
    return rounded(ts.win_ewm(panel, S, O, ["litres"], 5), 3, "litres_EW").drop("litres")


# Weights of the five-point quadratic fit, as 35ths, for the window's places one by one.
SG_ROWS = {"first": (31, 9, -3, -5, 3), "second": (9, 13, 12, 6, -5), "middle": (-3, 12, 17, 12, -3),
           "fourth": (-5, 6, 12, 13, 9), "fifth": (3, -5, -3, 9, 31)}


def sg_sql(weights, first: int, col: str = "litres") -> str:
    def at(k):
        return f"LEAD({col}, {k}) OVER w" if k > 0 else f"LAG({col}, {-k}) OVER w" if k < 0 else col
    return "(" + " + ".join(f"({wt}) * {at(first + j)}" for j, wt in enumerate(weights)) + ") / 35.0"


SAVGOL = f"""sg AS (SELECT series, ts, litres,
  CASE WHEN pos = 0 THEN {sg_sql(SG_ROWS["first"], 0)} WHEN pos = 1 THEN {sg_sql(SG_ROWS["second"], -1)}
       WHEN pos = n - 1 THEN {sg_sql(SG_ROWS["fifth"], -4)} WHEN pos = n - 2 THEN {sg_sql(SG_ROWS["fourth"], -3)}
       ELSE {sg_sql(SG_ROWS["middle"], -2)} END AS v
  FROM numbered {W})"""
NUMBERED = """numbered AS (SELECT series, ts, litres, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos,
  COUNT(*) OVER (PARTITION BY series) AS n FROM {source})"""
BACKFILLED = """filled AS (SELECT series, ts, COALESCE(litres, FIRST_VALUE(litres IGNORE NULLS) OVER (PARTITION BY series
  ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS litres FROM gaps)"""


@query("win_savgol", f"""WITH {GAPS}, {BACKFILLED}, {NUMBERED.format(source="filled")}, {SAVGOL}
SELECT series, ts, CAST(ROUND(CAST(v AS DECIMAL(38,7)), 3) AS DOUBLE) AS litres FROM sg""")
def win_savgol(spark, d):
    return rounded(ts.win_savgol(gap_panel(spark, d).select("series", "ts", "litres"), S, O, ["litres"]), 3, "litres")


@query("win_smooth_compare", f"""WITH {PANEL}, {NUMBERED.format(source="panel")}, {SAVGOL}, {ewm_sql("panel", 5)},
others AS (SELECT series, ts, AVG(litres) OVER (w ROWS 4 PRECEDING) AS ma, ({WMA_SUM}) / 210.0 AS wma FROM panel {W})
SELECT sg.series, sg.ts, sg.litres, CAST(ROUND(CAST(ma AS DECIMAL(38,7)), 3) AS DOUBLE) AS "litres_MA", CAST(ROUND(CAST(wma AS DECIMAL(38,7)), 3) AS DOUBLE) AS "litres_WMA", CAST(ROUND(CAST(ewm.v AS DECIMAL(38,7)), 3) AS DOUBLE) AS "litres_EW",
  CAST(ROUND(CAST(sg.v AS DECIMAL(38,7)), 3) AS DOUBLE) AS "litres_SG"
FROM sg JOIN others USING (series, ts) JOIN ewm USING (series, ts) WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' """)
def win_smooth_compare(spark, d):
    out = ts.win_smooth_compare(weekly_panel(spark, d).select("series", "ts", "litres"), S, O, "litres", "1996-01-01", "1997-12-31")
    return rounded(out, 3, "litres_MA", "litres_WMA", "litres_EW", "litres_SG")


@query("win_pct_change", f"""WITH {GAPS}, padded AS (SELECT series, ts, LAST_VALUE(litres IGNORE NULLS) OVER (w ROWS
  BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM gaps {W})
SELECT series, ts, CAST(ROUND(CAST(x / LAG(x) OVER w - 1 AS DECIMAL(38,11)), 7) AS DOUBLE) AS pct_change FROM padded {W}""")
def win_pct_change(spark, d):
    return rounded(ts.win_pct_change(gap_panel(spark, d), S, O, "litres"), 7, "pct_change").select("series", "ts", "pct_change")


@query("win_bfill", f"""WITH {GAPS}
SELECT series, ts, FIRST_VALUE(litres IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS litres FROM gaps {W}""")
def win_bfill(spark, d):
    return ts.win_bfill(gap_panel(spark, d).select("series", "ts", "litres"), S, O, ["litres"])


@query("win_ffill", f"""WITH {GAPS}
SELECT series, ts, LAST_VALUE(litres IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS litres FROM gaps {W}""")
def win_ffill(spark, d):
    return ts.win_ffill(gap_panel(spark, d).select("series", "ts", "litres"), S, O, ["litres"])


@query("win_ffill_raw", """WITH known AS (SELECT event_type, ts, event_id, CASE WHEN user_id % 4 = 0 THEN value END AS v FROM events)
SELECT event_id, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING
AND CURRENT ROW) AS v FROM known""")
def win_ffill_raw(spark, d):
    known = table(spark, d, "events").select(F.col("event_type").alias("series"), "ts", "event_id",
                                             F.when(F.col("user_id") % 4 == 0, F.col("value")).alias("v"))
    return fill_forward(known, S, ["ts", "event_id"], {"v": F.col("v")}, max_rows=1000).select("event_id", "v")


INTERPOLATED = """ends AS (SELECT MIN(ts) + CAST((7 - (isodow(MIN(ts)) - 1)) % 7 AS INTEGER) AS lo,
                                 MAX(ts) + CAST((7 - (isodow(MAX(ts)) - 1)) % 7 AS INTEGER) AS hi FROM inflation),
mondays AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS ts FROM ends),
points AS (SELECT m.ts, i.eu FROM mondays m LEFT JOIN inflation i USING (ts)),
near AS (SELECT ts, eu,
    LAST_VALUE(CASE WHEN eu IS NOT NULL THEN ts END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
    LAST_VALUE(eu IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    FIRST_VALUE(CASE WHEN eu IS NOT NULL THEN ts END IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
    FIRST_VALUE(eu IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM {points}),
line AS (SELECT ts, CASE WHEN eu IS NOT NULL THEN eu WHEN nt IS NULL THEN pv WHEN pt IS NULL THEN NULL
    ELSE pv + (nv - pv) * CAST(ts - pt AS DOUBLE) / CAST(nt - pt AS DOUBLE) END AS eu FROM near)"""


@query("win_interpolate", f"""WITH {INFLATION}, {INTERPOLATED.format(points="points")} SELECT ts, CAST(ROUND(CAST(eu AS DECIMAL(38,7)), 3) AS DOUBLE) AS eu FROM line""")
def win_interpolate(spark, d):
    """Only months that start on a Monday are anchors."""
    monthly = monthly_inflation(spark, d).withColumn("series", F.lit("eu"))
    return rounded(ts.win_interpolate(monthly, S, O, ["eu"]), 3, "eu").select("ts", "eu")


@query("win_interpolate_all", f"""WITH {INFLATION}, {INTERPOLATED.format(points='''(SELECT ts, eu FROM inflation
  UNION ALL SELECT ts, NULL FROM mondays WHERE ts NOT IN (SELECT ts FROM inflation))''')}
SELECT ts, CAST(ROUND(CAST(eu AS DECIMAL(38,7)), 3) AS DOUBLE) AS eu FROM line WHERE ts IN (SELECT ts FROM mondays)""")
def win_interpolate_all(spark, d):
    monthly = monthly_inflation(spark, d).withColumn("series", F.lit("eu"))
    return rounded(ts.win_interpolate(monthly, S, O, ["eu"], anchors="all"), 3, "eu").select("ts", "eu")


@query("win_week_counter", f"""WITH {PRICES}
SELECT series, ts, CAST((ROW_NUMBER() OVER w + 3) % 52 + 1 AS INTEGER) AS week FROM prices {W}""")
def win_week_counter(spark, d):
    return ts.win_week_counter(monthly_prices(spark, d), S, O).select("series", "ts", "week")


ACF = """centred AS (SELECT p.series, p.ts, p.litres - m.m AS x, ROW_NUMBER() OVER (PARTITION BY p.series ORDER BY p.ts) AS pos, m.n
  FROM panel p JOIN (SELECT series, AVG(litres) AS m, COUNT(*) AS n FROM panel GROUP BY series) m USING (series)),
acf AS (SELECT a.series, CAST(k.k AS INTEGER) AS lag, SUM(a.x * b.x) / MAX(v.var) AS acf, MAX(a.n) AS n
  FROM range(0, 41) k(k) JOIN centred a ON TRUE JOIN centred b ON a.series = b.series AND b.pos = a.pos + k.k
  JOIN (SELECT series, SUM(x * x) AS var FROM centred GROUP BY series) v ON v.series = a.series GROUP BY a.series, k.k)"""


@query("win_acf", f"""WITH {PANEL}, {ACF} SELECT series, lag, CAST(ROUND(CAST(acf AS DECIMAL(38,12)), 8) AS DOUBLE) AS acf, n FROM acf""")
def win_acf(spark, d):
    return rounded(ts.win_acf(weekly_panel(spark, d), S, O, "litres"), 8, "acf")


@query("win_pacf")
def win_pacf(spark, d):
    acf = ts.win_acf(weekly_panel(spark, d), S, O, "litres")
    return rounded(ts.win_pacf(acf, S), 8, "pacf")


@query("win_optimum_lag", f"""WITH {PANEL}, {ACF}
SELECT series, CAST(COALESCE(MIN(lag) FILTER (WHERE lag >= 1 AND abs(acf) < 1.96 / sqrt(n)), 40) AS INTEGER) AS optimum_lag
FROM acf GROUP BY series""")
def win_optimum_lag(spark, d):
    return ts.win_optimum_lag(ts.win_acf(weekly_panel(spark, d), S, O, "litres"), S)


TREND_SUM = " + ".join(f"{0.5 if abs(k) == 6 else 1.0} * " + (
    f"LEAD(litres, {k}) OVER w" if k > 0 else f"LAG(litres, {-k}) OVER w" if k < 0 else "litres") for k in range(-6, 7))


@query("win_decompose", f"""WITH {PANEL},
t AS (SELECT series, ts, litres, ({TREND_SUM}) / 12.0 AS trend, (ROW_NUMBER() OVER w - 1) % 12 AS phase FROM panel {W}),
pm AS (SELECT series, phase, AVG(litres - trend) AS m FROM t GROUP BY series, phase),
season AS (SELECT series, phase, m - AVG(m) OVER (PARTITION BY series) AS seasonal FROM pm)
SELECT series, ts, litres, CAST(ROUND(CAST(trend AS DECIMAL(38,6)), 2) AS DOUBLE) AS trend, CAST(ROUND(CAST(seasonal AS DECIMAL(38,6)), 2) AS DOUBLE) AS seasonal, CAST(ROUND(CAST(litres - trend - seasonal AS DECIMAL(38,6)), 2) AS DOUBLE) AS resid
FROM t JOIN season USING (series, phase)""")
def win_decompose(spark, d):
    out = ts.win_decompose(weekly_panel(spark, d).select("series", "ts", "litres"), S, O, "litres")
    return rounded(out, 2, "trend", "seasonal", "resid")


@query("win_infer_freq", f"""WITH {HOURLY}, g AS (SELECT series, CAST(epoch(ts) - epoch(LAG(ts) OVER w) AS BIGINT) AS gap FROM hourly {W}),
c AS (SELECT series, gap, COUNT(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY series, gap),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY n DESC, gap) AS rn FROM c)
SELECT series, gap AS gap_seconds FROM r WHERE rn = 1""")
def win_infer_freq(spark, d):
    return ts.win_infer_freq(hourly_readings(spark, d), S, O)


LAST_N = " + ".join(f"{i + 1} * LAG(value, {i}) OVER w" if i else "value" for i in range(100))


@query("win_last_n_vector", f"""WITH {HOURLY}, v AS (SELECT series, ts, {LAST_N} AS weighted FROM hourly {W})
SELECT series, ts, CAST(ROUND(CAST(weighted AS DECIMAL(38,7)), 3) AS DOUBLE) AS weighted FROM v WHERE weighted IS NOT NULL""")
def win_last_n_vector(spark, d):
    """The vector itself is checked through a sum weighted by place, which tells its order."""
    out = ts.win_last_n_vector(hourly_readings(spark, d), S, O, "value", 100)
    places = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.get("history", i - 1) * i)
    return out.select("series", "ts", half_up(F.aggregate(places, F.lit(0.0), lambda a, x: a + x), 3).alias("weighted"))


@query("udf_rolling", f"""WITH {PANEL}
SELECT series, ts, CASE WHEN COUNT(*) OVER (w ROWS 3 PRECEDING) = 4 THEN MAX(litres) OVER (w ROWS 3 PRECEDING)
  - MIN(litres) OVER (w ROWS 3 PRECEDING) END AS spread FROM panel {W}""")
def udf_rolling(spark, d):
    """A user function, here the range, over a full rolling window."""
    out = ts.rolling_apply(weekly_panel(spark, d), S, O, "litres", 4, lambda x: F.array_max(x) - F.array_min(x), "spread")
    return out.select("series", "ts", "spread")
