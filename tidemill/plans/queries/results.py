"""Error metrics and result analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import metrics as m
from tidemill.operators import evaluate as ev
from tidemill.plans.catalog import half_up, half_up_sql, query
from tidemill.plans.standins import PAIRS, PANEL, naive_pairs, weekly_panel

METRICS = {
    "met_mape": (m.met_mape, "AVG(abs((y_true - y_pred) / y_true)) FILTER (WHERE y_true <> 0) * 100", 6),
    "met_mape_fraction": (m.met_mape_fraction, "AVG(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16))", 8),
    "met_mae": (m.met_mae, "AVG(abs(y_true - y_pred))", 3),
    "met_medae": (m.met_medae, "MEDIAN(abs(y_true - y_pred))", 3),
    "met_me": (m.met_me, "AVG(y_true - y_pred)", 3),
    "met_mse": (m.met_mse, "AVG((y_true - y_pred) * (y_true - y_pred)) / 1e6", 3),
    "met_rmse": (m.met_rmse, "sqrt(AVG((y_true - y_pred) * (y_true - y_pred)))", 3),
    "met_r2": (m.met_r2, "1 - SUM((y_true - y_pred) * (y_true - y_pred)) / (COUNT(*) * var_pop(y_true))", 8),
}


def _metric(name: str) -> None:
    fn, sql, digits = METRICS[name]

    @query(name, f"WITH {PAIRS} SELECT series, model, {half_up_sql(sql, digits)} AS score FROM pairs GROUP BY series, model")
    def run(spark, d):
        if name == "met_medae":
            return ev.median_error(naive_pairs(spark, d), ["series", "model"]).select("series", "model", half_up("medae", digits).alias("score"))
        score = fn("y_true", "y_pred")
        scaled = score / 1e6 if name == "met_mse" else score
        return naive_pairs(spark, d).groupBy("series", "model").agg(half_up(scaled, digits).alias("score"))


for _name in METRICS:
    _metric(_name)

HORIZON_COLS = {"ape": 6, "mae": 3, "medae": 3, "me": 3, "rmse": 3}


@query("met_horizon", f"""WITH {PAIRS}, groups AS (SELECT DISTINCT model FROM pairs),
cal AS (SELECT model, CAST(unnest(range(1, 57)) AS INTEGER) AS horizon FROM groups),
e AS (SELECT model, horizon, AVG(abs((y_true - y_pred) / y_true)) * 100 AS ape, AVG(abs(y_true - y_pred)) AS mae,
  MEDIAN(abs(y_true - y_pred)) AS medae, AVG(y_true - y_pred) AS me, sqrt(AVG(power(y_true - y_pred, 2))) AS rmse
  FROM pairs GROUP BY model, horizon)
SELECT model, horizon, {", ".join(f"{half_up_sql(c, k)} AS {c}" for c, k in HORIZON_COLS.items())}
FROM cal LEFT JOIN e USING (model, horizon)""")
def met_horizon(spark, d):
    """Horizons 53 to 56 lie past the data and hold nulls."""
    out = ev.met_horizon(naive_pairs(spark, d), ["model"], 56)
    return out.select("model", "horizon", *[half_up(c, k).alias(c) for c, k in HORIZON_COLS.items()])


@query("score_pairs", f"""WITH {PAIRS}
SELECT model, COUNT(*) AS n, {half_up_sql("AVG(abs((y_true - y_pred) / y_true)) * 100", 6)} AS mape,
  {half_up_sql("MEDIAN(abs(y_true - y_pred))", 3)} AS medae,
  {half_up_sql(METRICS["met_r2"][1], 8)} AS r2 FROM pairs GROUP BY model""")
def score_pairs(spark, d):
    """All series pooled per model, the median found by narrowing rather than in one task."""
    out = ev.score_pairs(naive_pairs(spark, d), ["model"], max_rows=50)
    return out.select("model", "n", half_up("mape", 6).alias("mape"), half_up("medae", 3).alias("medae"), half_up("r2", 8).alias("r2"))


SCALERS = ["MinMaxScaler", "StandardScaler", "No scaling"]
SCORERS = ["F_regression", "No scoring"]

# Records of a made-up search whose errors come from the panel: ties, an error record and NaN included.
RECORDS = PANEL + """, base AS (SELECT series AS model, SUM(litres) / 1e8 AS b FROM panel GROUP BY series),
records AS (
  SELECT model, CAST(l.lag AS INTEGER) AS lag, s.scaler, c.scorer,
    CASE WHEN l.lag = 1 AND s.scaler = 'No scaling' THEN NULL
         WHEN l.lag = 2 AND c.scorer = 'F_regression' THEN 'nan'::DOUBLE
         ELSE b + abs(l.lag - 4) + CASE WHEN s.scaler = 'StandardScaler' THEN 0.5 ELSE 0 END END AS mape,
    CASE WHEN l.lag = 1 AND s.scaler = 'No scaling' THEN 'failed' END AS error,
    b * 10 + l.lag AS mae, CAST(l.lag AS DOUBLE) AS execution_time
  FROM base, range(1, 8) l(lag), (VALUES ('MinMaxScaler'), ('StandardScaler'), ('No scaling')) s(scaler),
       (VALUES ('F_regression'), ('No scoring')) c(scorer)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY mape, lag,
    CASE scaler WHEN 'MinMaxScaler' THEN 1 WHEN 'StandardScaler' THEN 2 ELSE 3 END,
    CASE scorer WHEN 'F_regression' THEN 1 ELSE 2 END) AS rn
  FROM records WHERE mape IS NOT NULL AND NOT isnan(mape)),
best AS (SELECT * FROM ranked WHERE rn = 1)"""


def records(spark, d):
    base = weekly_panel(spark, d).groupBy(F.col("series").alias("model")).agg((F.sum("litres") / 1e8).alias("b"))
    grid = (base.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(7))))
            .withColumn("scaler", F.explode(F.array(*map(F.lit, SCALERS))))
            .withColumn("scorer", F.explode(F.array(*map(F.lit, SCORERS)))))
    failed = (F.col("lag") == 1) & (F.col("scaler") == "No scaling")
    lost = (F.col("lag") == 2) & (F.col("scorer") == "F_regression")
    mape = F.col("b") + F.abs(F.col("lag") - 4) + F.when(F.col("scaler") == "StandardScaler", 0.5).otherwise(0.0)
    return grid.select("model", "lag", "scaler", "scorer",
                       F.when(~failed & lost, float("nan")).when(~failed, mape).alias("mape"),
                       F.when(failed, "failed").alias("error"), (F.col("b") * 10 + F.col("lag")).alias("mae"),
                       F.col("lag").cast("double").alias("execution_time"))


@query("best_config", f"""WITH {RECORDS}
SELECT model, lag, scaler, scorer, {half_up_sql("mape", 6)} AS mape FROM best""")
def best_config(spark, d):
    best = ev.best_config(records(spark, d), ["model"], SCALERS, SCORERS)
    return best.select("model", "lag", "scaler", "scorer", half_up("mape", 6).alias("mape"))


@query("best_config_min", f"""WITH {RECORDS}, above AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY mape, lag,
    CASE scaler WHEN 'MinMaxScaler' THEN 1 WHEN 'StandardScaler' THEN 2 ELSE 3 END,
    CASE scorer WHEN 'F_regression' THEN 1 ELSE 2 END) AS r2 FROM ranked WHERE mape > 8)
SELECT model, lag, scaler, scorer, {half_up_sql("mape", 6)} AS mape FROM above WHERE r2 = 1""")
def best_config_min(spark, d):
    """The older form, which also asks for an error above a bound."""
    best = ev.best_config(records(spark, d), ["model"], SCALERS, SCORERS, min_mape=8.0)
    return best.select("model", "lag", "scaler", "scorer", half_up("mape", 6).alias("mape"))


@query("leaderboard", f"""WITH {RECORDS}, named AS (SELECT series AS model, litres, ts FROM panel),
numbered AS (SELECT model, ROW_NUMBER() OVER (PARTITION BY model ORDER BY ts) AS horizon, litres FROM named)
SELECT b.model, {half_up_sql("b.mape", 6)} AS mape, l.litres AS mape_last, f.litres AS mape_first,
  {half_up_sql("b.mae", 6)} AS mae, b.execution_time, b.scaler, b.scorer, b.lag
FROM best b JOIN numbered f ON f.model = b.model AND f.horizon = 1 JOIN numbered l ON l.model = b.model AND l.horizon = 52""")
def leaderboard(spark, d):
    from tidemill.operators.layout import POS, number_rows

    best = ev.best_config(records(spark, d), ["model"], SCALERS, SCORERS)
    numbered = number_rows(weekly_panel(spark, d), ["series"], "ts")
    weekly = numbered.select(F.col("series").alias("model"), (F.col(POS) + 1).alias("horizon"), F.col("litres").alias("ape"))
    board = ev.leaderboard(best, weekly, 52)
    return board.withColumns({"mape": half_up("mape", 6), "mae": half_up("mae", 6)})


@query("chart_pred_frame", f"""WITH {PAIRS}
SELECT DISTINCT series, ts, 'Actual' AS label, y_true AS value FROM pairs
UNION ALL SELECT series, ts, model, y_pred FROM pairs""")
def chart_pred_frame(spark, d):
    pairs = naive_pairs(spark, d)
    actual = pairs.select("series", "horizon", "ts", "y_true").distinct()
    return ev.chart_pred_frame(actual, pairs.select("series", "horizon", "model", "y_pred"), ["series"])


@query("chart_pred_model", f"""WITH {PAIRS}
SELECT series, ts, 'Actual' AS label, y_true AS value FROM pairs WHERE model = 'season'
UNION ALL SELECT series, ts, model, y_pred FROM pairs WHERE model = 'season'""")
def chart_pred_model(spark, d):
    pairs = naive_pairs(spark, d)
    actual = pairs.select("series", "horizon", "ts", "y_true").distinct()
    return ev.chart_pred_frame(actual, pairs.select("series", "horizon", "model", "y_pred"), ["series"], model="season")


@query("chart_mape_frame", f"""WITH {PAIRS}
SELECT series, model, ts, horizon, {half_up_sql("abs((y_true - y_pred) / y_true) * 100", 6)} AS ape FROM pairs""")
def chart_mape_frame(spark, d):
    pairs = naive_pairs(spark, d)
    errors = ev.met_horizon(pairs, ["series", "model"], 60)
    dates = pairs.select("series", "horizon", "ts").distinct()
    return ev.chart_mape_frame(errors, dates, s=["series"]).withColumn("ape", half_up("ape", 6))
