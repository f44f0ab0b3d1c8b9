"""What the search works out for all folds at once, against the same thing done fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.ml import search
from tidemill.ml.gram import correlations, descend_many, gram_blocks, lasso_path
from tidemill.ml.histograms import Bins, joint_counts, mutual_information
from tidemill.ml.trees import Job, TreeModel, bin_rows, fold_errors, grow, importances, to_bins
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.scale import fit_scaler
from tidemill.operators.score import score_f, score_importance, score_mi, score_pearson

FEATS = ["a", "b", "c.1", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 3]
    x[:, 3] = np.round(x[:, 3])
    y = 3 * x[:, 0] + np.where(x[:, 1] > 2, 6.0, 0.0) + rng.normal(size=n) * 0.3
    gaps = rng.random(n) < 0.4
    rows = [(int(i * 6 // n), *[None if gaps[i] and j == 2 else float(v) for j, v in enumerate(x[i])], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "block int, a double, b double, `c.1` double, d double, y double").repartition(3)
    x[gaps, 2] = np.nan
    return df, np.arange(n) * 6 // n, x, y


def plain_information(x, y, xb, yb):
    counts = np.zeros((10, 10))
    known = ~np.isnan(x)
    np.add.at(counts, (xb.place(x[known]), yb.place(y[known])), 1)
    p = counts / counts.sum()
    return sum(p[i, j] * np.log(p[i, j] / p[i].sum() / p[:, j].sum()) for i, j in zip(*np.nonzero(p)))


def test_joint_counts_of_blocks_add_up_to_folds(data):
    df, block, x, y = data
    widths = [Bins(float(np.nanmin(c)), float(np.nanmax(c))) for c in x.T]
    cuts = [Bins(cuts=tuple(np.nanquantile(c, np.arange(1, 10) / 10))) for c in x.T]
    yb = Bins(float(y.min()), float(y.max()))
    counts = joint_counts(df, FEATS, "y", [widths, cuts], yb, "block")
    for fold in (1, 4):
        total = sum(c for b, c in counts.items() if b < fold)
        alone = joint_counts(df.where(F.col("block") < fold), FEATS, "y", [widths, cuts], yb)[0]
        assert np.array_equal(total, alone)
        for s, bins in enumerate((widths, cuts)):
            want = [plain_information(x[block < fold, j], y[block < fold], bins[j], yb) for j in range(4)]
            assert mutual_information(total[s]) == pytest.approx(want)
    got = {r[0]: r[1] for r in score_mi(df, FEATS, "y").collect()}
    assert [got[f] for f in FEATS] == pytest.approx([plain_information(x[:, j], y, widths[j], yb) for j in range(4)])


def test_scores_keep_rows_with_gaps_and_are_those_of_the_search(data):
    df, block, x, y = data
    filled = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    r = np.array([np.corrcoef(filled[:, j], y)[0, 1] for j in range(4)])
    got = {row[0]: row[1] for row in score_pearson(df, FEATS, "y").collect()}
    assert [got[f] for f in FEATS] == pytest.approx(abs(r))
    f = {row[0]: row[1] for row in score_f(df, FEATS, "y").collect()}
    assert [f[k] for k in FEATS] == pytest.approx(r ** 2 / (1 - r ** 2) * (len(y) - 2))
    whole = sum(list(gram_blocks(df, FEATS, "y").values())[1:], gram_blocks(df, FEATS, "y")[0])
    assert correlations(whole) == pytest.approx(r)


def test_many_trees_are_the_trees_grown_alone(data):
    df, block, x, y = data
    binned = bin_rows(df, FEATS, "y", "block")
    jobs = [Job(None, 1, 4, 5), Job(3, 1, 3), Job(None, 2, 5, 1, 2, None, True), Job(None, 3, 6, 2, None, (0, 1), False, True), Job(2, 5, 30)]
    together = grow(binned, jobs)
    for job, tree in zip(jobs, together):
        alone = grow(binned, [job])[0]
        for column, values in vars(tree).items():
            assert getattr(alone, column) == pytest.approx(values)
    bins = to_bins(x, binned.cuts, binned.fill)
    leaves = together[0].nodes(bins)
    assert min(np.bincount(leaves)[np.unique(leaves)]) >= 5
    assert together[0].predict(bins) == pytest.approx([y[leaves == k].mean() for k in leaves])
    assert set(np.unique([f for f in together[3].feature if f >= 0])) <= {0, 1}
    assert together[4].predict(bins[block < 2]) == pytest.approx(y[block < 2], abs=1.0)
    # the first cut is the best of all
    best = max((np.var(y) * len(y) - sum(np.var(y[s]) * s.sum() for s in (bins[:, j] <= c, bins[:, j] > c) if s.any()), -j, -c)
               for j in range(4) for c in range(31))
    assert together[0].gain[0] == pytest.approx(best[0]) and (together[0].feature[0], together[0].cut[0]) == (-best[1], -best[2])


def test_fold_errors_and_tree_models(data):
    df, block, x, y = data
    binned = bin_rows(df, FEATS, "y", "block")
    trees = grow(binned, [Job(3, 1, 4), Job(3, 2, 4, 1, 2, None, True)])
    (r2, train, test), = fold_errors(binned, [(3, trees)])
    model = TreeModel(tuple(FEATS), binned.cuts, binned.fill, trees)
    pred = {(r["y"], r["a"]): r["prediction"] for r in model.transform(df).collect()}
    p = np.array([pred[b, a] for a, b in zip(x[:, 0], y)])
    held = block == 3
    assert test == pytest.approx(((y - p)[held] ** 2).mean()) and train == pytest.approx(((y - p)[block < 3] ** 2).mean())
    assert r2 == pytest.approx(1 - ((y - p)[held] ** 2).sum() / ((y[held] - y[held].mean()) ** 2).sum())


def test_importance_of_all_folds(data):
    df, *_ = data
    binned = bin_rows(df, FEATS, "y", "block")
    both = importances(binned, [2, None], num_trees=10)
    assert both[None] == pytest.approx(importances(binned, [None], num_trees=10)[None]) and both[2] == pytest.approx(importances(binned, [2], num_trees=10)[2])
    assert both[None].argmax() == 0 and both[None][:2].sum() > 0.9
    got = {r[0]: r[1] for r in score_importance(df, FEATS, "y", num_trees=10).collect()}
    assert max(got, key=got.get) == "a" and sum(got.values()) == pytest.approx(1)


def test_lasso_path_is_where_descent_ends():
    rng = np.random.default_rng(5)
    for k, corr in ((6, 0.0), (25, 0.8), (40, 0.99)):
        z = np.repeat(rng.normal(size=(400, 8)), 5, axis=1)[:, :k] * corr + rng.normal(size=(400, k)) * np.sqrt(1 - corr ** 2)
        z[:, k // 2] = 0.0
        y = z @ rng.normal(size=k) * 5 + rng.normal(size=400)
        xx, xy, lam = z.T @ z, z.T @ (y - y.mean()), 400 * np.array([0.01, 1.0, 0.2, 50.0])
        path = lasso_path(xx, xy, lam)
        many = descend_many(np.array([xx] * 4), np.array([xy] * 4), lam, np.zeros(4), np.full(4, 1e-13), 20_000)
        assert path == pytest.approx(many, rel=1e-5, abs=1e-6) and not path[3].any()


def test_quantiles_of_all_folds(data):
    df, block, x, _ = data
    folds = search.Folds(df, FEATS, "y", 5, 50, ("quantile", "robust"))
    for kind in ("quantile", "robust"):
        for fold in (1, 4, None):
            alone = fit_scaler(folds.part(fold), FEATS, kind, **({"n_quantiles": 50} if kind == "quantile" else {}))
            mine = folds.scaler(kind, fold)
            for f in FEATS:
                assert mine.tables.get(f) == pytest.approx(alone.tables.get(f)) and mine.affine.get(f) == pytest.approx(alone.affine.get(f))
    many = exact_quantiles(df, FEATS, np.linspace(0, 1, 40)).collect()
    few = {(r["column_name"], p): r["quantiles"][0] for p in (0.0, 1 / 39, 20 / 39, 1.0) for r in exact_quantiles(df, FEATS, [p]).collect()}
    for r in many:
        assert [r["quantiles"][i] for i in (0, 1, 20, 39)] == pytest.approx([few[r["column_name"], p] for p in (0.0, 1 / 39, 20 / 39, 1.0)], rel=1e-12)


def test_tree_search_over_folds_and_draws(data):
    df, *_ = data
    outcome, records = search.search_grid(df, FEATS, "y", "DecisionTreeRegressor", {"max_depth": [1, 5], "min_instances": [2]}, scorer="F_regression")
    got = [r.cv_r2 for r in records.orderBy("draw").collect()]
    assert outcome.params["max_depth"] == 5 and got[1] > got[0] and outcome.r2 == got[1]
    assert outcome.predict(df).where("y_pred IS NULL").count() == 0
