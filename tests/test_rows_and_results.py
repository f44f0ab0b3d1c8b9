import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import calendar as cal, metrics as m
from tidemill.operators import aggregates as agg, clean, evaluate as ev, scale
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.split import split_tail, split_ts_cv
from tidemill.sources.upsert import merge_keyed, read_keyed, sink_upsert


def test_week_keys(spark):
    days = [dt.date(2008, 12, 28) + dt.timedelta(days=i) for i in range(1472)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select("d", cal.week_key("d").alias("iso"), cal.week_key("d", "calendar_iso").alias("cal"),
                     cal.week_key("d", "monday").alias("mon")).collect()
    for r in rows:
        year, week, _ = r.d.isocalendar()
        assert r.iso == f"{year}_{week}" and r.cal == f"{r.d.year}_{week}" and r.mon == f"{r.d.year}_{int(r.d.strftime('%W'))}"
    keys = {r.d: r.cal for r in rows}
    assert keys[dt.date(2012, 1, 1)] == "2012_52" and keys[dt.date(2012, 12, 31)] == "2012_1"


def test_month_range_compares_text(spark):
    df = spark.createDataFrame([("2008-12",), ("2009-01",), ("2009-02",), ("2021-12",)], "month string")
    got = [r.month for r in clean.filter_month_string(df, "month", "2009-01-01", "2021-12-31").collect()]
    assert got == ["2009-02", "2021-12"]


def test_allzero_columns_keep_nulls(spark):
    df = spark.createDataFrame([(0.0, None, 0.0), (0.0, 0.0, 2.0)], "a double, b double, c double")
    assert clean.filter_allzero_cols(df, ["a", "b", "c"]).columns == ["b", "c"]


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([(1.0,)], "litres double")
    with pytest.raises(KeyError, match="Required columns 'num_suppliers' or 'litres' are missing"):
        clean.check_columns(df, ["num_suppliers", "litres"])


def test_keep_first_per_column(spark, tmp_path):
    new = spark.createDataFrame([(1, None, 5.0, 1), (1, 2.0, None, 2), (1, 3.0, 6.0, 3)], "k int, a double, b double, seq long")
    empty = new.select("k", "a", "b").limit(0)
    assert [tuple(r) for r in sink_upsert(empty, new, "k", ["a", "b"], "seq").collect()] == [(1, 2.0, 5.0)]
    path, t = str(tmp_path / "table"), dt.datetime(2024, 1, 1, 5)
    schema = "series string, time timestamp, a double, b double, seq long"
    batches = [[("x", t, None, 5.0, 1)], [("x", t, 2.0, 9.0, 2), ("y", t, 7.0, None, 3)],
               [("x", t + dt.timedelta(days=1), 1.0, 1.0, 4)]]
    for rows in [*batches, batches[1]]:
        merge_keyed(spark.createDataFrame(rows, schema), path, ["series", "time"], ["a", "b"], "time", "seq")
    got = {(r.series, r.time): (r.a, r.b) for r in read_keyed(spark, path).collect()}
    assert got == {("x", t): (2.0, 5.0), ("y", t): (7.0, None), ("x", t + dt.timedelta(days=1)): (1.0, 1.0)}


def test_metrics_skip_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 11.0), (20.0, 16.0)], "y double, p double")
    row = df.agg(m.met_mape("y", "p").alias("mape"), m.met_mae("y", "p").alias("mae"), m.met_r2("y", "p").alias("r2")).first()
    assert row.mape == pytest.approx(15.0) and row.mae == pytest.approx(10 / 3) and row.r2 == pytest.approx(1 - 42 / 200)
    assert df.filter("y = 0").agg(m.met_mape("y", "p")).first()[0] is None


def test_horizons_past_the_data_are_null(spark):
    df = spark.createDataFrame([("m", h, float(h), 1.1 * h) for h in (1, 2, 3)], "model string, horizon int, y_true double, y_pred double")
    got = {r.horizon: r.ape for r in ev.met_horizon(df, ["model"], 5).collect()}
    assert [got[h] for h in (1, 2, 3)] == pytest.approx([10.0] * 3) and got[4] is None and got[5] is None


def test_best_configuration(spark):
    rows = [("m", 2, "B", "y", 5.0), ("m", 2, "A", "z", 5.0), ("m", 3, "A", "y", 5.0), ("m", 1, "A", "y", None),
            ("m", 1, "A", "z", math.nan), ("m", 4, "A", "y", 0.5)]
    df = spark.createDataFrame(rows, "model string, lag int, scaler string, scorer string, mape double")
    best = ev.best_config(df.filter("lag < 4"), ["model"], ["A", "B"], ["y", "z"]).first()
    assert (best.lag, best.scaler, best.scorer) == (2, "A", "z")
    assert ev.best_config(df, ["model"], ["A", "B"], ["y", "z"]).first().lag == 4
    assert ev.best_config(df, ["model"], ["A", "B"], ["y", "z"], min_mape=1).first().lag == 2


def test_split_and_folds(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)], "s string, t int")
    blocks = {r.t: r.block for r in split_ts_cv(df, ["s"], "t").collect()}
    for fold, (lo, hi) in enumerate([(10, 18), (18, 26), (26, 34), (34, 42), (42, 50)], 1):
        assert {t for t, b in blocks.items() if b == fold} == set(range(lo, hi))
    tail = {r.t: r.horizon for r in split_tail(df, ["s"], "t", 8).filter("is_test").collect()}
    assert tail == {42 + i: i + 1 for i in range(8)}


def test_exact_quantiles_on_skewed_values(spark):
    rng = np.random.default_rng(3)
    heavy = np.concatenate([np.zeros(900), np.exp(rng.normal(0, 6, 1500)), [1e300, -1e300]])
    rows = [("big", float(v)) for v in heavy] + [("small", float(v)) for v in range(7)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["x"], probs, ["g"], max_rows=20).collect()}
    assert got["big"] == pytest.approx(np.quantile(heavy, probs).tolist())
    assert got["small"] == pytest.approx(np.quantile(range(7), probs).tolist())


def test_scalers_against_numpy(spark):
    x = np.random.default_rng(5).integers(0, 50, 300).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    iqr = np.quantile(x, 0.75) - np.quantile(x, 0.25)
    want = {"minmax": (x - x.min()) / (x.max() - x.min()), "standard": (x - x.mean()) / x.std(), "robust": (x - np.median(x)) / iqr}
    for kind, w in want.items():
        out = scale.apply_scaler(df, ["x"], scale.fit_scaler(df, ["x"], kind)).orderBy("i").toPandas()["x"]
        np.testing.assert_allclose(out, w, rtol=1e-9, atol=1e-12)
    q, ref = np.quantile(x, np.linspace(0, 1, 100)), np.linspace(0, 1, 100)
    both = 0.5 * (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1]))
    both[x <= q[0]], both[x >= q[-1]] = 0.0, 1.0
    params = scale.fit_scaler(df, ["x"], "quantile", n_quantiles=100)
    out = scale.apply_scaler(df, ["x"], params).orderBy("i").toPandas()["x"]
    np.testing.assert_allclose(out, both, atol=1e-12)
    constant = scale.fit_scaler(df.select(F.lit(3.0).alias("x")), ["x"], "minmax")
    assert scale.apply_scaler(df.select(F.lit(3.0).alias("x")), ["x"], constant).first().x == 0.0


def test_correlation_and_sums_of_rows_that_know_both(spark):
    rows = [(1, 1e9 + 1, 2.0, 3.0), (1, 1e9 + 2, None, 5.0), (2, 1e9 + 4, 7.0, float("nan")), (2, 1e9 + 3, 1.0, 8.0), (None, None, 4.0, 2.0)]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "g int, a double, b double, y double, same double")
    pdf = df.toPandas()
    got = {(r.feature_a, r.feature_b): r.corr for r in agg.agg_corr_matrix(df, ["a", "b", "y", "same"]).collect()}
    # the plain library loses digits beside a large constant
    want = pdf[["a", "b", "y"]].sub({"a": 1e9, "b": 0, "y": 0}).corr()
    for i in ("a", "b", "y"):
        assert got[i, "same"] is None
        for j in ("a", "b", "y"):
            assert abs(got[i, j] - want.loc[i, j]) < 1e-9
    sums = {(r.g, r.a, r.b): r.v for r in agg.agg_gram(df.withColumn("y", F.nanvl("y", F.lit(None).cast("double"))), ["b"], "y", "g").collect()}
    assert sums[1, "1", "1"] == 2 and sums[1, "1", "b"] == 2 and sums[1, "b", "y"] == 6 and sums[2, "1", "y"] == 8 and sums[None, "b", "b"] == 16
    assert agg.agg_corr_matrix(df.limit(0), ["a", "b"]).count() == 4
