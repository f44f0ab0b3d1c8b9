"""Imputation, scaling, scoring, fitting and search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.ml import knn, models, registry, search
from tidemill.plans.queries.sources import scratch
from tidemill.sources import model_store
from tidemill.operators import impute, scale, score
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.split import split_tail, split_ts_cv
from tidemill.operators.timeseries import win_lag_features
from tidemill.plans.catalog import half_up, half_up_sql, query
from tidemill.plans.queries.aggregates import CV_BLOCK
from tidemill.plans.queries.shaping import F_SQL, PLACED, SCORED
from tidemill.plans.standins import GAPS, PANEL, gap_panel, table, weekly_panel

S, O = ["series"], "ts"
Y = "litres"


def rsql(expr: str, digits: int, name: str) -> str:
    return f"{half_up_sql(expr, digits)} AS {name}"


# --- imputation

@query("imp_mean", f"""WITH {GAPS}, m AS (SELECT AVG(litres) AS a, AVG(n_orders) AS b FROM gaps)
SELECT series, ts, {rsql("COALESCE(litres, a)", 3, "litres")}, {rsql("COALESCE(n_orders, b)", 6, "n_orders")} FROM gaps, m""")
def imp_mean(spark, d):
    out = impute.imp_mean(gap_panel(spark, d).select("series", "ts", "litres", "n_orders"), ["litres", "n_orders"])
    return out.select("series", "ts", half_up("litres", 3).alias("litres"), half_up("n_orders", 6).alias("n_orders"))


@query("imp_mean_train", f"""WITH {GAPS}, m AS (SELECT series, AVG(litres) AS a FROM gaps WHERE ts < DATE '2000-01-01' GROUP BY series)
SELECT series, ts, {rsql("COALESCE(litres, a)", 3, "litres")} FROM gaps JOIN m USING (series)""")
def imp_mean_train(spark, d):
    """Means per series from the train part only."""
    gaps = gap_panel(spark, d).select("series", "ts", "litres")
    out = impute.imp_mean(gaps, ["litres"], F.col("ts") < F.lit("2000-01-01").cast("date"), by=S)
    return out.withColumn("litres", half_up("litres", 3))


@query("imp_model")
def imp_model(spark, d):
    gaps = gap_panel(spark, d).withColumn("week", F.weekofyear("ts"))
    out = impute.imp_model(gaps, "litres", ["week"])
    return out.select("series", "ts", half_up("litres", 2).alias("litres"))


@query("imp_seasonal", f"""WITH {GAPS}, m AS (SELECT series, weekofyear(ts) AS week, AVG(litres) AS a FROM gaps GROUP BY ALL)
SELECT g.series, g.ts, {rsql("COALESCE(g.litres, m.a)", 3, "litres")}
FROM gaps g JOIN m ON m.series = g.series AND m.week = weekofyear(g.ts)""")
def imp_seasonal(spark, d):
    gaps = gap_panel(spark, d).withColumn("week", F.weekofyear("ts"))
    return impute.imp_seasonal(gaps, "litres", "week", S).select("series", "ts", half_up("litres", 3).alias("litres"))


# --- scaling

SCALED = ["litres", "n_orders"]
LINES = ["l_quantity", "l_extendedprice"]


def _scaler_sql(shift: str, div: str, cols=SCALED) -> str:
    cells = [rsql(f"({c} - {shift.format(c=c)}) / {div.format(c=c)}", 8, c) for c in cols]
    return f"WITH {PANEL} SELECT series, ts, {', '.join(cells)} FROM panel"


def _scaled(spark, d, fn):
    out, _ = fn(weekly_panel(spark, d).select("series", "ts", *SCALED), SCALED)
    return out.select("series", "ts", *[half_up(c, 8).alias(c) for c in SCALED])


@query("scale_minmax", _scaler_sql("(SELECT MIN({c}) FROM panel)", "((SELECT MAX({c}) FROM panel) - (SELECT MIN({c}) FROM panel))"))
def scale_minmax(spark, d):
    return _scaled(spark, d, scale.scale_minmax)


@query("scale_standard", _scaler_sql("(SELECT AVG({c}) FROM panel)", "(SELECT STDDEV_POP({c}) FROM panel)"))
def scale_standard(spark, d):
    return _scaled(spark, d, scale.scale_standard)


@query("scale_robust", _scaler_sql(
    "(SELECT MEDIAN({c}) FROM panel)", "((SELECT QUANTILE_CONT({c}, 0.75) FROM panel) - (SELECT QUANTILE_CONT({c}, 0.25) FROM panel))"))
def scale_robust(spark, d):
    return _scaled(spark, d, scale.scale_robust)


@query("scale_robust_lines", f"""WITH q AS (SELECT MEDIAN(l_extendedprice) AS m,
  QUANTILE_CONT(l_extendedprice, 0.75) - QUANTILE_CONT(l_extendedprice, 0.25) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, {rsql("(l_extendedprice - m) / r", 8, "l_extendedprice")} FROM lineitem, q""")
def scale_robust_lines(spark, d):
    """Quantiles of a whole fact table, found by narrowing histograms instead of one task's count map."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out, _ = scale.scale_robust(lines, ["l_extendedprice"], max_rows=2000)
    return out.withColumn("l_extendedprice", half_up("l_extendedprice", 8))


@query("scale_quantile")
def scale_quantile(spark, d):
    return _scaled(spark, d, scale.scale_quantile)


@query("scale_none", f"WITH {PANEL} SELECT series, ts, {', '.join(rsql(c, 8, c) for c in SCALED)} FROM panel")
def scale_none(spark, d):
    return _scaled(spark, d, scale.scale_none)


@query("scale_inverse", f"WITH {PANEL} SELECT series, ts, {', '.join(rsql(c, 3, c) for c in SCALED)} FROM panel")
def scale_inverse(spark, d):
    scaled, params = scale.scale_minmax(weekly_panel(spark, d).select("series", "ts", *SCALED), SCALED)
    back = scale.scale_inverse(scaled, SCALED, params)
    return back.select("series", "ts", *[half_up(c, 3).alias(c) for c in SCALED])


@query("exact_quantiles", " UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS column_name, COUNT({c}) AS n, {rsql(f"QUANTILE_CONT({c}, 0.1)", 4, "q10")},
  {rsql(f"QUANTILE_CONT({c}, 0.5)", 4, "q50")}, {rsql(f"QUANTILE_CONT({c}, 0.99)", 4, "q99")} FROM lineitem GROUP BY l_returnflag"""
    for c in LINES))
def quantiles_query(spark, d):
    out = exact_quantiles(table(spark, d, "lineitem"), LINES, [0.1, 0.5, 0.99], ["l_returnflag"], max_rows=1000)
    return out.select("l_returnflag", "column_name", "n", *[
        half_up(F.col("quantiles")[i], 4).alias(n) for i, n in enumerate(("q10", "q50", "q99"))])


# --- scoring

@query("score_f", f"WITH {PANEL}, s AS ({F_SQL}) SELECT feature, {rsql('score', 4, 'score')} FROM s")
def score_f(spark, d):
    return score.score_f(weekly_panel(spark, d), SCORED, Y).withColumn("score", half_up("score", 4))


@query("score_pearson", f"WITH {PANEL} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {rsql(f'abs(corr({f}, litres))', 8, 'score')} FROM panel" for f in SCORED))
def score_pearson(spark, d):
    return score.score_pearson(weekly_panel(spark, d), SCORED, Y).withColumn("score", half_up("score", 8))


def _bin(c: str) -> str:
    lo, hi = f"(SELECT MIN({c})::DOUBLE FROM panel)", f"(SELECT MAX({c})::DOUBLE FROM panel)"
    return f"CAST(least(floor((CAST({c} AS DOUBLE) - {lo}) / ({hi} - {lo}) * 10), 9) AS INTEGER)"


MI_ROWS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {_bin(f)} AS bx, {_bin('litres')} AS by_ FROM panel" for f in SCORED)


@query("score_mi", f"""WITH {PANEL}, r AS ({MI_ROWS}), c AS (SELECT feature, bx, by_, COUNT(*) AS c FROM r GROUP BY ALL),
m AS (SELECT feature, c, SUM(c) OVER (PARTITION BY feature, bx) AS cx, SUM(c) OVER (PARTITION BY feature, by_) AS cy,
  SUM(c) OVER (PARTITION BY feature) AS n FROM c)
SELECT feature, {rsql("greatest(SUM(CAST(c AS DOUBLE) / n * ln(CAST(c AS DOUBLE) * n / (CAST(cx AS DOUBLE) * cy))), 0)", 8, "score")} FROM m GROUP BY feature""")
def score_mi(spark, d):
    return score.score_mi(weekly_panel(spark, d), SCORED, Y).withColumn("score", half_up("score", 8))


@query("score_importance")
def score_importance(spark, d):
    return score.score_importance(weekly_panel(spark, d), SCORED, Y).withColumn("score", half_up("score", 6))


KBEST_LONG = " UNION ALL ".join(f"SELECT series, ts, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM panel" for c in SCORED)


@query("select_kbest", f"""WITH {PANEL}, s AS ({F_SQL}), best AS (SELECT feature FROM s ORDER BY score DESC, feature LIMIT 2),
long AS ({KBEST_LONG}) SELECT series, ts, feature, value FROM long JOIN best USING (feature)""")
def select_kbest(spark, d):
    """All numeric columns compete; the rows name those that were kept."""
    panel = weekly_panel(spark, d)
    numeric = [f.name for f in panel.schema if isinstance(f.dataType, T.NumericType) and f.name != Y]
    chosen, kept = score.select_kbest(panel, numeric, Y, "F_regression", 2, keys=["series", "ts"])
    return chosen.select("series", "ts", *[F.col(c).cast("double").alias(c) for c in kept]) \
        .unpivot(["series", "ts"], kept, "feature", "value")


@query("udf_scorer", f"""WITH {PANEL} SELECT 'n_orders' AS feature, {rsql("covar_pop(n_orders, litres)", 2, "score")} FROM panel
UNION ALL SELECT 'week', {half_up_sql("covar_pop(week, litres)", 2)} FROM panel""")
def udf_scorer(spark, d):
    """A scorer a user registers: covariance with the target."""
    def covariance(df, features, y):
        one = df.agg(*[F.covar_pop(f, y).alias(f) for f in features])
        return one.unpivot([], list(features), "feature", "score")

    registry.register_scorer("Covariance", covariance, k=1)
    try:
        return registry.SCORERS["Covariance"](weekly_panel(spark, d), ["n_orders", "week"], Y).withColumn("score", half_up("score", 2))
    finally:
        for names in (registry.SCORERS, registry.K_VALUES, score.SCORERS, score.K_VALUES):
            names.pop("Covariance", None)


@query("udf_scaler", _scaler_sql("0.0", "(SELECT MAX(ABS({c})) FROM panel)"))
def udf_scaler(spark, d):
    """A scaler a user registers: by the largest absolute value."""
    def max_abs(df, cols):
        row = df.agg(*[F.max(F.abs(F.col(f"`{c}`"))) for c in cols]).first()
        return {c: (0.0, v) for c, v in zip(cols, row)}

    registry.register_scaler("MaxAbsScaler", max_abs)
    try:
        panel = weekly_panel(spark, d).select("series", "ts", *SCALED)
        out = scale.apply_scaler(panel, SCALED, registry.fit_named_scaler(panel, SCALED, "MaxAbsScaler"))
    finally:
        registry.unregister_scaler("MaxAbsScaler")
    return out.select("series", "ts", *[half_up(c, 8).alias(c) for c in SCALED])


@query("udf_model")
def udf_model(spark, d):
    """A model a user registers, with its own parameter values, searched like the built-in ones."""
    registry.register_model(registry.ModelSpec("StiffRidge", models.fit_ridge, {"alpha": [10.0, 100.0]}, gram="ridge"))
    try:
        outcome, records = search.search_grid(feature_rows(spark, d), FEATS, Y, "StiffRidge")
    finally:
        registry.MODELS.pop("StiffRidge")
    return records.select("model", "draw", "params", half_up("cv_r2", 6).alias("cv_r2"), half_up("test_mse", 0).alias("test_mse"))


# --- fits

FEATS = ["n_orders", "num_suppliers", "n_orders-1", "num_suppliers-1"]


def feature_rows(spark, d):
    panel = weekly_panel(spark, d).select("series", "ts", "litres", "n_orders", "num_suppliers")
    lagged = win_lag_features(panel, S, O, ["n_orders", "num_suppliers"], 1)
    return split_ts_cv(lagged, S, O, 5)


def one_feature(spark, d):
    return weekly_panel(spark, d).select("series", "ts", "litres", F.col("n_orders").cast("double").alias("n_orders"))


SUMS = PANEL + """, sums AS (SELECT AVG(n_orders) AS mx, AVG(litres) AS my, COUNT(*) AS n, regr_sxx(litres, n_orders) AS sxx,
  regr_sxy(litres, n_orders) AS sxy FROM panel)"""


def _one_fit(name: str, slope: str, fit) -> None:
    @query(name, f"""WITH {SUMS} SELECT series, ts, {rsql(f"my + ({slope}) * (n_orders - mx)", 2, "prediction")} FROM panel, sums""")
    def run(spark, d):
        panel = one_feature(spark, d)
        return fit(panel).transform(panel).select("series", "ts", half_up("prediction", 2).alias("prediction"))


_one_fit("fit_linear", "sxy / sxx", lambda p: models.fit_linear(p, ["n_orders"], Y))
_one_fit("fit_ridge", "sxy / (sxx + 0.6)", lambda p: models.fit_ridge(p, ["n_orders"], Y, alpha=0.6))
_one_fit("fit_lasso", "sign(sxy) * greatest(abs(sxy) - 0.8 * n, 0) / sxx", lambda p: models.fit_lasso(p, ["n_orders"], Y, alpha=0.8))
_one_fit("fit_elasticnet", "sign(sxy) * greatest(abs(sxy) - 0.5 * n, 0) / (sxx + 0.5 * n)",
         lambda p: models.fit_elasticnet(p, ["n_orders"], Y, alpha=1.0, l1_ratio=0.5))


@query("fit_linear_many")
def fit_linear_many(spark, d):
    rows = feature_rows(spark, d)
    return models.fit_linear(rows, FEATS, Y).transform(rows).select("series", "ts", half_up("prediction", 2).alias("prediction"))


def _model_query(name: str, fit) -> None:
    @query(name)
    def run(spark, d):
        rows = feature_rows(spark, d)
        tagged = split_tail(rows, S, O, 52)
        fitted = fit(tagged.filter(~F.col("is_test")))
        return fitted.transform(tagged.filter("is_test")).select("series", "ts", "horizon", half_up("prediction", 2).alias("prediction"))


_model_query("fit_bayesridge", lambda t: models.fit_bayesridge(t, FEATS, Y))
_model_query("fit_tree", lambda t: models.fit_tree(t, FEATS, Y, max_depth=8, min_instances=5))
_model_query("fit_extratree", lambda t: models.fit_extratree(t, FEATS, Y, max_depth=8))
_model_query("fit_forest", lambda t: models.fit_forest(t, FEATS, Y))
_model_query("fit_boosted", lambda t: models.fit_boosted(t, FEATS, Y))


KNN_SQL = f"""WITH {PLACED}, rows AS (SELECT *, series || '|' || CAST(ts AS VARCHAR) AS id, CAST(n_orders AS DOUBLE) AS x1,
  CAST(num_suppliers AS DOUBLE) AS x2, CAST(week AS DOUBLE) AS x3 FROM placed),
dist AS (SELECT q.id, q.series, q.ts, t.litres, {{distance}} AS d, t.id AS tid
  FROM rows q JOIN rows t ON q.rn > q.n - 52 AND t.rn <= t.n - 52),
near AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d, tid) AS k FROM dist)
SELECT series, ts, {{value}} FROM near WHERE k <= 5 GROUP BY series, ts"""
KNN_FEATS = ["n_orders", "num_suppliers", "week"]


def _knn(spark, d, weights: str, p: int):
    panel = weekly_panel(spark, d).withColumn("id", F.concat_ws("|", "series", F.col("ts").cast("string")))
    tagged = split_tail(panel, S, O, 52)
    fitted = knn.fit_knn(tagged.filter(~F.col("is_test")), KNN_FEATS, Y, "id", 5, weights, p)
    out = fitted.transform(tagged.filter("is_test"), "id")
    return out.select("series", "ts", half_up("prediction", 2).alias("prediction"))


@query("fit_knn", KNN_SQL.format(distance="sqrt(power(q.x1 - t.x1, 2) + power(q.x2 - t.x2, 2) + power(q.x3 - t.x3, 2))",
                                 value=rsql("AVG(litres)", 2, "prediction")))
def fit_knn(spark, d):
    return _knn(spark, d, "uniform", 2)


@query("fit_knn_distance", KNN_SQL.format(
    distance="power(power(abs(q.x1 - t.x1), 3) + power(abs(q.x2 - t.x2), 3) + power(abs(q.x3 - t.x3), 3), 1.0 / 3)",
    value=rsql("CASE WHEN MIN(d) = 0 THEN AVG(litres) FILTER (WHERE d = 0) ELSE SUM(litres / NULLIF(d, 0)) / SUM(1 / NULLIF(d, 0)) END",
               2, "prediction")))
def fit_knn_distance(spark, d):
    return _knn(spark, d, "distance", 3)


def steps_sql(n: int) -> str:
    """One-feature ridge for each of the next ``n`` weeks, over the rows that have all of them."""
    steps = range(1, n + 1)
    return f"""WITH {PANEL}, led AS (SELECT series, ts, n_orders, {", ".join(f"LEAD(litres, {i}) OVER w AS t{i}" for i in steps)}
  FROM panel WINDOW w AS (PARTITION BY series ORDER BY ts)),
full_ AS (SELECT * FROM led WHERE t{n} IS NOT NULL),
fit AS (SELECT AVG(n_orders) AS mx, regr_sxx(t1, n_orders) AS sxx, {", ".join(
    f"AVG(t{i}) AS m{i}, regr_sxy(t{i}, n_orders) AS s{i}" for i in steps)} FROM full_)
SELECT series, ts, {", ".join(rsql(f"m{i} + s{i} / (sxx + 1.0) * (n_orders - mx)", 2, f"step_{i}") for i in steps)} FROM full_, fit"""


def step_model(spark, d, n: int):
    from tidemill.operators.timeseries import win_multistep

    rows = win_multistep(one_feature(spark, d), S, O, Y, n)
    return rows, models.fit_multi_output(rows, ["n_orders"], [f"{Y}_step_{i}" for i in range(1, n + 1)], "ridge", alpha=1.0)


def stepped(rows, fitted, n: int):
    return fitted.transform(rows).select("series", "ts", *[half_up(f"step_{i}", 2).alias(f"step_{i}") for i in range(1, n + 1)])


@query("fit_multi_output", steps_sql(3))
def fit_multi_output(spark, d):
    """Three steps ahead from one pass over the data."""
    rows, fitted = step_model(spark, d, 3)
    return stepped(rows, fitted, 3)


@query("model_store_steps", steps_sql(24))
def model_store_steps(spark, d):
    """A model of 24 steps, stored, loaded and then used."""
    rows, fitted = step_model(spark, d, 24)
    path = scratch(spark, "steps")
    model_store.save_model(spark, fitted, path)
    return stepped(rows, model_store.load_model(spark, path), 24)


@query("fit_seasonal_naive", f"""WITH {PLACED}, last_year AS (SELECT series, litres, rn - (n - 52) AS phase FROM placed WHERE rn > n - 52)
SELECT series, CAST(phase + k * 52 AS INTEGER) AS horizon, litres AS prediction FROM last_year, range(0, 2) r(k) WHERE phase + k * 52 <= 78""")
def fit_seasonal_naive(spark, d):
    """78 weeks ahead, so the last year repeats one and a half times."""
    return models.fit_seasonal_naive(weekly_panel(spark, d), S, O, Y, 78, 52)


def smooth_sql(rows: str) -> str:
    """The recursion itself over ``rows`` (key, rn, x), for every rate pair; then the pair with the smallest error."""
    return f"""rates AS (SELECT i * 9 + j AS pair, 0.1::DOUBLE + j * 0.1::DOUBLE AS a, CASE WHEN i = 0 THEN 0 ELSE 0.1::DOUBLE + (i - 1) * 0.1::DOUBLE END AS b
  FROM range(0, 10) r(i), range(0, 9) q(j)),
run AS (SELECT key, rn, pair, a, b, x AS level, 0::DOUBLE AS trend, 0::DOUBLE AS sse FROM {rows}, rates WHERE rn = 1
  UNION ALL SELECT key, rn, pair, a, b, new, b * (new - level) + (1 - b) * trend, sse + err * err
  FROM (SELECT r.key, p.rn, pair, a, b, level, trend, sse, p.x - (level + trend) AS err, a * p.x + (1 - a) * (level + trend) AS new
    FROM run r JOIN {rows} p ON p.key = r.key AND p.rn = r.rn + 1)),
ends AS (SELECT key, arg_min(level, (sse, pair)) AS level, arg_min(trend, (sse, pair)) AS trend
  FROM run JOIN (SELECT key, max(rn) AS rn FROM {rows} GROUP BY key) USING (key, rn) GROUP BY key)"""


@query("fit_expsmooth", f"""WITH RECURSIVE {PLACED}, points AS (SELECT series AS key, rn, CAST(litres AS DOUBLE) AS x FROM placed), {smooth_sql("points")}
SELECT key AS series, CAST(h AS INTEGER) AS horizon, {rsql("level + h * trend", 2, "prediction")} FROM ends, range(1, 53) r(h)""")
def fit_expsmooth(spark, d):
    out = models.fit_expsmooth(weekly_panel(spark, d), S, O, Y, 52)
    return out.withColumn("prediction", half_up("prediction", 2))


# --- search

@query("search_grid")
def search_grid(spark, d):
    _, records = search.search_grid(feature_rows(spark, d), FEATS, Y, "Ridge", scaler="StandardScaler", scorer="F_regression")
    return records.select("model", "draw", "params", half_up("cv_r2", 6).alias("cv_r2"), half_up("train_mse", 0).alias("train_mse"),
                          half_up("test_mse", 0).alias("test_mse"))


CV_FIT = CV_BLOCK + """, folds AS (SELECT f.fold, regr_slope(b.litres, b.n_orders) AS slope, regr_intercept(b.litres, b.n_orders) AS icept
  FROM range(1, 6) f(fold) JOIN blocked b ON b.block < f.fold GROUP BY f.fold),
oof AS (SELECT b.series, b.ts, b.block, b.litres, icept + slope * n_orders AS y_pred FROM blocked b JOIN folds ON fold = block)"""


@query("cv_predict", f"""WITH {CV_FIT} SELECT series, ts, block, {rsql("y_pred", 2, "y_pred")} FROM oof""")
def cv_predict(spark, d):
    rows = split_ts_cv(one_feature(spark, d), S, O, 5)
    out = search.cv_predict(rows, ["n_orders"], Y, "LinearRegression")
    return out.select("series", "ts", "block", half_up("y_pred", 2).alias("y_pred"))


@query("cv_report", f"""WITH {CV_FIT} SELECT block, COUNT(*) AS n, {rsql("AVG(power(litres - y_pred, 2)) / 1e6", 2, "mse")},
  {rsql("1 - SUM(power(litres - y_pred, 2)) / (COUNT(*) * var_pop(litres))", 6, "r2")} FROM oof GROUP BY block""")
def cv_report(spark, d):
    rows = split_ts_cv(one_feature(spark, d), S, O, 5)
    report = search.cv_report(search.cv_predict(rows, ["n_orders"], Y, "LinearRegression"), Y)
    return report.select("block", "n", half_up(F.col("mse") / 1e6, 2).alias("mse"), half_up("r2", 6).alias("r2"))


@query("search_grid_tree")
def search_grid_tree(spark, d):
    """The same search with MLlib fits, here of regression trees."""
    _, records = search.search_grid(feature_rows(spark, d), FEATS, Y, "DecisionTreeRegressor")
    return records.select("model", "draw", "params", half_up("cv_r2", 6).alias("cv_r2"), half_up("test_mse", 0).alias("test_mse"))


def _matrix(spark, d):
    """All linear models, with every lag, draw, scaler and scorer of the defaults."""
    from tidemill.ml import registry
    from tidemill.plans.forecast import evaluate
    from tidemill.settings import Settings

    panel = weekly_panel(spark, d).withColumnRenamed("week", "Week")
    return evaluate(panel, S, O, Y, Settings(), [name for name, spec in registry.MODELS.items() if spec.gram])


@query("search_matrix")
def search_matrix(spark, d):
    """Linear models x lags x scalers x scorers; errors would show in ``error``."""
    done = _matrix(spark, d)
    return done.results.select("model", "lag", "scaler", "scorer", half_up("mape", 4).alias("mape"), half_up("cv_r2", 4).alias("cv_r2"),
                               F.size("selected").alias("n_selected"), "error")


@query("forecast_evaluation")
def forecast_evaluation(spark, d):
    """The whole evaluation down to the leaderboard (less the run time, which differs every time)."""
    done = _matrix(spark, d)
    return done.board.select("model", half_up("mape", 4).alias("mape"), half_up("mape_last", 4).alias("mape_last"),
                             half_up("mape_first", 4).alias("mape_first"), "scaler", "scorer", "lag")
