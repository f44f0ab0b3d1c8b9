import numpy as np
import pytest

from tidemill.ml import knn, models, registry, search
from tidemill.ml.gram import errors, fit_from_gram, gram_blocks
from tidemill.operators.split import split_tail, split_ts_cv

FEATS = ["a", "b", "c-1"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 240
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [100, -3, 7]
    y = 3 * x[:, 0] - 0.5 * x[:, 1] + 4 * x[:, 2] + rng.normal(size=n)
    rows = [("s", i, *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, t int, a double, b double, `c-1` double, y double").repartition(4)
    return split_ts_cv(df, ["s"], "t"), x, y


def ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    return b, y.mean() - x.mean(0) @ b


def test_gram_fits_match_closed_forms_and_mllib(data):
    df, x, y = data
    blocks = gram_blocks(df, FEATS, "y")
    total = sum(list(blocks.values())[1:], list(blocks.values())[0])
    fit = fit_from_gram(total, FEATS, "ridge", {"alpha": 0.7})
    b, c = ridge(x, y, 0.7)
    assert fit.coef == pytest.approx(b) and fit.intercept == pytest.approx(c)
    lib = models.fit_ridge(df, FEATS, "y", alpha=0.7).model
    assert list(lib.coefficients) == pytest.approx(b, rel=1e-6)
    for kind, params, got in (("lasso", {"alpha": 0.4, "tol": 1e-12}, models.fit_lasso(df, FEATS, "y", alpha=0.4).model),
                              ("elasticnet", {"alpha": 0.4, "l1_ratio": 0.5, "tol": 1e-12}, models.fit_elasticnet(df, FEATS, "y", alpha=0.4).model)):
        assert fit_from_gram(total, FEATS, kind, params).coef == pytest.approx(list(got.coefficients), rel=1e-4, abs=1e-5)
    mse, r2 = errors(total, fit, FEATS)
    pred = x @ b + c
    assert mse == pytest.approx(((y - pred) ** 2).mean()) and r2 == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    bayes = models.fit_bayesridge(df, FEATS, "y")
    assert bayes.coef == pytest.approx(np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0], rel=0.05)


def test_search_matches_numpy_folds(data):
    df, x, y = data
    outcome, records = search.search_grid(df, FEATS, "y", "Ridge", {"alpha": [0.1, 50.0]}, scaler="StandardScaler")
    size = 240 // 6
    want = []
    for alpha in (0.1, 50.0):
        scores = []
        for i in range(1, 6):
            cut, end = 240 - (6 - i) * size, 240 - (5 - i) * size
            mean, sd = x[:cut].mean(0), x[:cut].std(0)
            b, c = ridge((x[:cut] - mean) / sd, y[:cut], alpha)
            pred = ((x[cut:end] - mean) / sd) @ b + c
            scores.append(1 - ((y[cut:end] - pred) ** 2).sum() / ((y[cut:end] - y[cut:end].mean()) ** 2).sum())
        want.append(np.mean(scores))
    assert [r.cv_r2 for r in records.orderBy("draw").collect()] == pytest.approx(want)
    assert outcome.params == {"alpha": 0.1}


def test_failed_configurations_become_records(data, spark):
    df, _, _ = data
    tagged = split_tail(df.drop("block"), ["s"], "t", 20)
    train = split_ts_cv(tagged.filter("NOT is_test").drop("horizon"), ["s"], "t")
    registry.register_model(registry.ModelSpec("Broken", lambda *a, **k: 1 / 0))
    try:
        results, pred = search.search_matrix({1: (train, tagged.filter("is_test"))}, {1: FEATS}, "y", ["Ridge", "Broken"],
                                             ["No scaling"], ["No scoring"], ["s", "t", "horizon"], n_iter=2)
    finally:
        registry.MODELS.pop("Broken")
    got = {r.model: r for r in results.collect()}
    assert "division by zero" in got["Broken"].error and got["Broken"].mape is None
    assert got["Ridge"].error is None and got["Ridge"].mape > 0 and pred.count() == 20


def test_knn_against_brute_force(data, spark):
    df, x, y = data
    train, ask = df.filter("t < 200"), df.filter("t >= 200")
    for weights, p in (("uniform", 2), ("distance", 4)):
        near = knn.fit_knn(train, FEATS, "y", "t", 7, weights, p)
        found = near.neighbours(ask, "t", block_rows=9)
        assert found.count() == 40 * 7
        got = {r.t: r.prediction for r in near.transform(ask, "t").collect()}
        for t in range(200, 240):
            d = (np.abs(x[:200] - x[t]) ** p).sum(1) ** (1 / p)
            best = np.argsort(d)[:7]
            w = np.ones(7) if weights == "uniform" else 1 / d[best]
            assert got[t] == pytest.approx((y[best] * w).sum() / w.sum())


def test_seasonal_naive_wraps(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "s string, t int, y double")
    got = {r.horizon: r.prediction for r in models.fit_seasonal_naive(df, ["s"], "t", "y", 7, 4).collect()}
    assert got == {1: 6, 2: 7, 3: 8, 4: 9, 5: 6, 6: 7, 7: 8}


def test_parameter_draws():
    space = registry.MODELS["KNeighborsRegressor"].space
    draws = registry.draw_params(space, 30, 1)
    assert len(draws) == 30 and len({tuple(d.items()) for d in draws}) == 30 and draws == registry.draw_params(space, 30, 1)
    assert len(registry.draw_params({"alpha": [1, 2]}, 30, 1)) == 2 and registry.draw_params({}, 30, 1) == [{}]


def test_quantile_scaler_and_binned_scorer_in_the_search(data):
    df, x, y = data
    outcome, records = search.search_grid(df, FEATS, "y", "Ridge", {"alpha": [0.1]}, n_splits=1, scaler="QuantileTransformer",
                                          scorer="Mutual_info_regression")
    assert outcome.selected == FEATS and 0.3 < records.first().cv_r2 < 1
    pred = outcome.predict(df).select("y", "y_pred").toPandas()
    assert np.corrcoef(pred.y, pred.y_pred)[0, 1] > 0.9


def test_out_of_fold_predictions_of_a_tree(data):
    df, _, y = data
    out = search.cv_predict(df, FEATS, "y", "DecisionTreeRegressor", {"max_depth": 3})
    assert out.count() == 200
    assert search.cv_report(out, "y").count() == 5


def test_knn_in_many_dimensions_with_equal_rows(spark):
    """Blocks of few rows, a hundred features, and a row that stands in the train set many times."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 100))
    x[40:90] = x[40]
    names = [f"f.{i}" for i in range(100)]
    df = spark.createDataFrame([(i, float(i), *map(float, row)) for i, row in enumerate(x)], ["id", "y", *names])
    near = knn.fit_knn(df.filter("id % 4 <> 0"), names, "y", "id", 6).neighbours(df.filter("id % 4 = 0"), "id", block_rows=10)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], []).append((r["distance"], r["train_key"]))
    train = [i for i in range(120) if i % 4]
    for q in range(0, 120, 4):
        want = sorted((float(np.sqrt(((x[q] - x[t]) ** 2).sum())), t) for t in train)[:6]
        assert [t for _, t in sorted(got[q])] == [t for _, t in want]


def test_knn_visits_few_blocks_of_grouped_rows(spark):
    """Ten groups in a hundred dimensions: with several pivots nearly all blocks of other groups are passed over."""
    rng = np.random.default_rng(8)
    x = rng.normal(scale=20.0, size=(10, 100))[np.arange(600) % 10] + rng.standard_normal((600, 100))
    names = [f"f{i}" for i in range(100)]
    df = spark.createDataFrame([(i, float(i), *map(float, row)) for i, row in enumerate(x)], ["id", "y", *names])
    train, ask = df.filter("id >= 60"), df.filter("id < 60")
    near = knn.fit_knn(train, names, "y", "id", 3)
    blocks, table, home = near.blocks(ask, "id", 20)
    assert table.agg({"_n": "max"}).first()[0] <= 40 and table.agg({"_n": "sum"}).first()[0] == 540
    found = near.neighbours(ask, "id", 20).toPandas()
    far = found.groupby("id")["distance"].max()
    reach = spark.createDataFrame([(int(i), float(v) * (1 + 1e-9), [-1]) for i, v in far.items()], "_key long, _far double, _seen array<long>")
    visited = near.choose(home.join(reach, "_key"), table, 20, again=True)
    assert visited.join(table, "_b").agg({"_n": "sum"}).first()[0] <= 0.3 * 60 * 540
    for q in range(60):
        d = np.sqrt(((x[60:] - x[q]) ** 2).sum(1))
        assert sorted(found[found["id"] == q]["train_key"]) == sorted(60 + np.argsort(d, kind="stable")[:3])


def test_knn_fills_gaps_and_takes_few_rows(spark):
    rows = [(0, 1.0, 2.0, 5.0), (1, None, 4.0, 7.0), (2, 3.0, None, 9.0), (3, 5.0, 6.0, None)]
    train = spark.createDataFrame(rows, "id int, a double, b double, y double")
    ask = spark.createDataFrame([(7, None, 3.0), (8, 2.0, 4.0)], "id int, a double, b double")
    got = knn.fit_knn(train, ["a", "b"], "y", "id", 2).neighbours(ask, "id").collect()
    filled = {0: (1.0, 2.0), 1: (2.0, 4.0), 2: (3.0, 3.0)}
    for q, at in ((7, (2.0, 3.0)), (8, (2.0, 4.0))):
        want = sorted((((a - at[0]) ** 2 + (b - at[1]) ** 2) ** 0.5, t) for t, (a, b) in filled.items())[:2]
        assert sorted((r.distance, r.train_key) for r in got if r.id == q) == [(pytest.approx(d), t) for d, t in want]
    none = knn.fit_knn(train.limit(0), ["a", "b"], "y", "id", 2)
    assert none.neighbours(ask, "id").count() == 0 and knn.fit_knn(train, ["a", "b"], "y", "id", 9).neighbours(ask, "id").count() == 6


def test_trees_deeper_than_the_library_are_refused():
    assert models.tree_depth(None) == models.MAX_TREE_DEPTH and models.tree_depth(4) == 4
    with pytest.raises(ValueError):
        models.tree_depth(64)


def test_gaps_are_filled_with_the_train_means_of_the_fold(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3.0, 2.0, (200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    gaps = rng.random((200, 3)) < 0.4
    block = np.arange(200) // 100
    rows = [(int(b), *(None if g else float(v) for v, g in zip(row, gap)), float(t)) for b, row, gap, t in zip(block, x, gaps, y)]
    grams = gram_blocks(spark.createDataFrame(rows, "block int, a double, b double, `c-1` double, y double"), FEATS, "y")
    known = np.where(gaps, np.nan, x)
    means = np.nanmean(known[block == 0], axis=0)
    train, test = (np.where(np.isnan(known[block == k]), means, known[block == k]) for k in (0, 1))
    yt, yv = y[block == 0], y[block == 1]
    fit = fit_from_gram(grams[0], FEATS, "linear", {})
    beta = np.linalg.lstsq(np.column_stack([np.ones(100), train]), yt, rcond=None)[0]
    assert grams[0].n == 100 and fit.coef == pytest.approx(beta[1:]) and fit.intercept == pytest.approx(beta[0])
    mse, r2 = errors(grams[1], fit, FEATS)
    left = yv - beta[0] - test @ beta[1:]
    assert mse == pytest.approx((left**2).mean()) and r2 == pytest.approx(1 - (left**2).sum() / ((yv - yv.mean()) ** 2).sum())


def test_every_model_kind_comes_back_from_the_store(spark, data, tmp_path):
    from tidemill.sources import model_store

    train = data[0].limit(100)
    fits = [fit_from_gram(gram_blocks(train.selectExpr("*", "0 AS one"), FEATS, "y", "one")[0], FEATS, "ridge", {}),
            models.fit_tree(train, FEATS, "y", 3), knn.fit_knn(train, FEATS, "y", "t", 3)]
    for n, fitted in enumerate(fits):
        model_store.save_model(spark, fitted, str(tmp_path / str(n)))
        back = model_store.load_model(spark, str(tmp_path / str(n)))
        args = (train, "t") if n == 2 else (train,)
        want, got = ({r["t"]: r["prediction"] for r in m.transform(*args).select("t", "prediction").collect()} for m in (fitted, back))
        assert got == pytest.approx(want)
    with pytest.raises(TypeError):
        model_store.save_model(spark, object(), str(tmp_path / "none"))


def test_registered_searches_take_the_defaults(monkeypatch):
    from unittest.mock import MagicMock

    from tidemill.plans import forecast
    from tidemill.plans.queries import fitting
    from tidemill.settings import Settings

    seen = []
    monkeypatch.setattr(forecast, "evaluate", lambda *args, **kw: seen.append((args, kw)) or MagicMock())
    monkeypatch.setattr(search, "search_grid", lambda *args, **kw: seen.append((args, kw)) or (None, MagicMock()))
    for name in ("weekly_panel", "feature_rows", "half_up", "F"):
        monkeypatch.setattr(fitting, name, MagicMock())
    for q in (fitting.search_matrix, fitting.forecast_evaluation):
        q(None, "")
        args, kw = seen.pop()
        assert args[4] == Settings() and not args[6:] and not kw
        assert set(args[5]) == {"BayesianRidge", "Lasso", "ElasticNet", "LinearRegression", "Ridge"}
    fitting.search_grid_tree(None, "")
    assert seen.pop()[1] == {}


def test_rows_with_gaps_count_in_every_fit(spark, tmp_path):
    from tidemill.sources import model_store

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = 2 * x[:, 0] + x[:, 1] + 0.1 * rng.normal(size=200)
    x[::2, 1] = np.nan
    df = spark.createDataFrame([(i, float(a), None if np.isnan(b) else float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))],
                               "t int, a double, `b.1` double, y double")
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    coef, start = ridge_any(filled, y, 0.5)
    fitted = models.fit_ridge(df, ["a", "b.1"], "y", alpha=0.5)
    assert list(fitted.model.coefficients) == pytest.approx(coef, rel=1e-6)
    model_store.save_model(spark, fitted, str(tmp_path / "m"))
    for model in (fitted, model_store.load_model(spark, str(tmp_path / "m"))):
        got = {r["t"]: r["prediction"] for r in model.transform(df).collect()}
        assert [got[i] for i in range(200)] == pytest.approx(filled @ coef + start)
    for fit in (models.fit_tree, models.fit_linear, models.fit_lasso):
        assert fit(df, ["a", "b.1"], "y").transform(df).where("prediction IS NULL").count() == 0


def ridge_any(x, y, alpha):
    xc = x - x.mean(0)
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    return b, y.mean() - x.mean(0) @ b


def smooth_plain(x, horizon, steps=9):
    rates = np.linspace(0.1, 0.9, steps)
    best = None
    for b in np.concatenate([[0.0], rates]):
        for a in rates:
            level, trend, sse = x[0], 0.0, 0.0
            for v in x[1:]:
                ahead = level + trend
                sse += (v - ahead) ** 2
                new = a * v + (1 - a) * ahead
                level, trend = new, b * (new - level) + (1 - b) * trend
            if best is None or sse < best[0]:
                best = sse, level, trend
    return [best[1] + h * best[2] for h in range(1, horizon + 1)]


def test_smoothing_composed_of_pieces_equals_the_whole_run(spark):
    rng = np.random.default_rng(4)
    series = {"long": 700, None: 90, "one": 1, "two": 2, "flat": 50}
    data = {k: (np.full(n, 3.0) if k == "flat" else 1000 + np.cumsum(rng.normal(size=n)) + np.arange(n) * 0.3) for k, n in series.items()}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    # points without a value are left out; a series of none gives no rows
    rows += [("long", 10_000, None), ("long", -5, float("nan")), ("empty", 1, None)]
    df = spark.createDataFrame(rows, "s string, t int, x double").repartition(4)
    for args in ({}, {"piece_rows": 7, "fan": 3}, {"piece_rows": 1, "fan": 10}, {"piece_rows": 20, "fan": 2, "max_rows": 40}):
        got = models.fit_expsmooth(df, ["s"], "t", "x", 5, **args).toPandas()
        assert set(got["s"].where(got["s"].notna(), None)) == set(data) and len(got) == 5 * len(data)
        for k, x in data.items():
            mine = got[got["s"].isna() if k is None else got["s"] == k].sort_values("horizon")
            assert list(mine["prediction"]) == pytest.approx(smooth_plain(x, 5), rel=1e-9), (k, args)
    assert models.fit_expsmooth(df.limit(0), ["s"], "t", "x", 5).count() == 0
