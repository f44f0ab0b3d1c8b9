import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import joins, layout, timeseries as ts
from tidemill.operators.layout import LEN, POS, cut_series, number_rows
from tidemill.operators.reshape import month_to_weeks, reshape_asfreq

S, O = ["s"], "t"


@pytest.fixture(scope="module")
def frame(spark):
    """One hot series (most rows), two small ones, a null key, gaps in the values."""
    rng = np.random.default_rng(7)
    rows = []
    for key, n in (("hot", 700), ("a", 40), ("b", 11), (None, 30)):
        for i in range(n):
            rows.append((key, i * 3 + int(rng.integers(0, 3)), None if rng.random() < 0.1 else float(rng.normal())))
    return spark.createDataFrame(rows, "s string, t long, x double").repartition(5).cache()


def values(df, *cols):
    got = df.select("s", "t", *[F.col(f"`{c}`") for c in cols]).collect()
    out = {}
    for r in got:
        assert (r[0], r[1]) not in out
        out[(r[0], r[1])] = tuple(r[2:])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None), (k, x, y)
            if x is not None:
                assert x == pytest.approx(y, rel=1e-9, abs=1e-12), k


OPS = {
    "lags": (lambda df, m: ts.win_lag_features(df, S, O, ["x"], 3, dropna=False, max_rows=m), ["x-1", "x-2", "x-3"]),
    "leads": (lambda df, m: ts.win_multistep(df, S, O, "x", 4, dropna=False, max_rows=m), ["x_step_1", "x_step_4"]),
    "expanding": (lambda df, m: ts.win_expanding_mean(df, S, O, "x", max_rows=m), ["past_values"]),
    "past": (lambda df, m: ts.win_expanding_mean(df, S, O, "x", include_current=False, max_rows=m), ["past_values"]),
    "ma": (lambda df, m: ts.win_ma(df, S, O, ["x"], 5, max_rows=m), ["x_MA"]),
    "ewm": (lambda df, m: ts.win_ewm(df, S, O, ["x"], 5, max_rows=m), ["x_EW"]),
    "savgol": (lambda df, m: ts.win_savgol(df, S, O, ["x"], suffix="_SG", max_rows=m), ["x_SG"]),
    "ffill": (lambda df, m: ts.win_ffill(df, S, O, ["x"], m), ["x"]),
    "bfill": (lambda df, m: ts.win_bfill(df, S, O, ["x"], m), ["x"]),
    "change": (lambda df, m: ts.win_pct_change(df, S, O, "x", max_rows=m), ["pct_change"]),
    "place": (lambda df, m: number_rows(df, S, O, m), [POS, LEN]),
    "counter": (lambda df, m: ts.win_week_counter(df, S, O, max_rows=m), ["week"]),
}


@pytest.mark.parametrize("name", list(OPS))
def test_cut_series_give_the_same_rows(frame, name):
    run, cols = OPS[name]
    same(values(run(frame, None), *cols), values(run(frame, 50), *cols))


@pytest.fixture(scope="module")
def crowded(spark):
    """A hot series most of whose rows have one time or none, told apart by further columns, one of them text."""
    rng = np.random.default_rng(3)
    rows = [("hot", None if i % 10 == 0 else 5 if i % 10 < 8 else int(rng.integers(0, 900)), None if i % 7 == 0 else i % 3, f"{i:07d}",
             None if rng.random() < 0.1 else float(rng.normal())) for i in range(1500)]
    rows += [("a", i, 0, "x", float(i)) for i in range(20)]
    return spark.createDataFrame(rows, "s string, t long, u int, v string, x double").repartition(5).cache()


def test_rows_of_one_time_are_cut_by_the_rest_of_the_key(crowded):
    key = ["t", "u", "v"]
    cut = cut_series(crowded, S, key, 50)
    sizes = {r[1]: r[2] for r in cut.per_piece(S, F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 1500 and max(sizes.values()) <= 120 and len(sizes) <= cut.rows
    # pieces follow the key
    rows = cut.df.filter("s = 'hot'").orderBy(*[F.col(c).asc_nulls_last() for c in key]).select("_piece").collect()
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)

    def by_key(df, *cols):
        return {tuple(r[:4]): tuple(r[4:]) for r in df.select("s", *key, *cols).collect()}

    ops = {
        "place": (lambda m: number_rows(crowded, S, key, m), [POS, LEN]),
        "ffill": (lambda m: ts.win_ffill(crowded, S, key, ["x"], m), ["x"]),
        "bfill": (lambda m: ts.win_bfill(crowded, S, key, ["x"], m), ["x"]),
        "lags": (lambda m: ts.win_lag_features(crowded, S, key, ["x"], 3, dropna=False, max_rows=m), ["x-1", "x-3"]),
        "expanding": (lambda m: ts.win_expanding_mean(crowded, S, key, "x", max_rows=m), ["past_values"]),
    }
    for name, (run, cols) in ops.items():
        cols = [f"`{c}`" for c in cols]
        same(by_key(run(None), *cols), by_key(run(50), *cols))


def test_cuts_of_few_points_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(layout, "FAN", 4)
    # 1,500 rows in pieces of 40, of which one time holds 300 and 30 rows have no time
    rows = [("hot", None if i < 30 else 500 if i < 330 else i, i, float(i % 7)) for i in range(1500)] + [("cold", i, i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "s string, t int, n int, x double").repartition(5)
    plan = layout.plan_cut(df, S, ["t", "n"], 40)
    assert plan.pieces == 4 and plan.finer is not None and plan.rest is not None
    cut = layout.cut_series(df, S, ["t", "n"], plan)
    got = cut.df.filter("s = 'hot'").orderBy(F.col("t").asc_nulls_last(), "n").select("_piece").collect()
    pieces = [r[0] for r in got]
    assert len(pieces) == 1500 and pieces == sorted(pieces) and min(pieces) >= 0
    assert max(pieces.count(p) for p in set(pieces)) <= 80 and len(set(pieces)) <= cut.rows
    assert {r[0] for r in cut.df.filter("s = 'cold'").select("_piece").collect()} == {-1}
    one, many = (ts.win_expanding_mean(df, S, ["t", "n"], "x", max_rows=m).select("s", "n", "past_values").collect() for m in (None, plan))
    assert {(r.s, r.n): round(r.past_values, 9) for r in one} == {(r.s, r.n): round(r.past_values, 9) for r in many}


def test_smoothers_match_pandas(frame):
    pdf = frame.filter("s = 'hot'").toPandas().sort_values("t").set_index("t")["x"]
    df = frame.filter("s = 'hot'")
    want = {"x_MA": pdf.rolling(5, min_periods=1).mean(), "x_EW": pdf.ewm(span=5).mean()}
    got = ts.win_ewm(ts.win_ma(df, S, O, ["x"], 5), S, O, ["x"], 5).toPandas().sort_values("t").set_index("t")
    for c, w in want.items():
        pd.testing.assert_series_equal(got[c], w, check_names=False, rtol=1e-9)
    weights = np.arange(1, 21)
    wma = pdf.rolling(20).apply(lambda v: v @ weights / weights.sum(), raw=True)
    got = ts.win_wma(df, S, O, ["x"], 20, dropna=False).toPandas().sort_values("t").set_index("t")["x_WMA"]
    pd.testing.assert_series_equal(got, wma, check_names=False, rtol=1e-9)


def test_savgol_fixed_rows_and_short_series(spark):
    x = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 3.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "s string, t int, x double")
    got = [r.x for r in ts.win_savgol(df, S, O, ["x"]).orderBy("t").collect()]
    rows = {0: ((31, 9, -3, -5, 3), 0), 1: ((9, 13, 12, 6, -5), 0), 5: ((-5, 6, 12, 13, 9), 2), 6: ((3, -5, -3, 9, 31), 2)}
    for i in range(7):
        w, start = rows.get(i, ((-3, 12, 17, 12, -3), i - 2))
        assert got[i] == pytest.approx(sum(a * b for a, b in zip(w, x[start:start + 5])) / 35)
    with pytest.raises(Exception, match="shorter than the smoothing window"):
        ts.win_savgol(df.filter("t < 4"), S, O, ["x"]).collect()


def test_interpolation_modes(spark):
    months = [dt.date(2009 + i // 12, i % 12 + 1, 1) for i in range(24)]
    df = spark.createDataFrame([("a", m, float(i)) for i, m in enumerate(months)], "s string, t date, x double")
    grid = {r.t: r.x for r in ts.win_interpolate(df, S, O, ["x"]).collect()}
    assert all(t.weekday() == 0 for t in grid)
    anchors = {m: float(i) for i, m in enumerate(months) if m.weekday() == 0}
    assert {t: grid[t] for t in anchors} == anchors and len(anchors) == 4
    first, last = min(anchors), max(anchors)
    assert all(grid[t] is None for t in grid if t < first) and all(grid[t] == anchors[last] for t in grid if t > last)
    full = {r.t: r.x for r in ts.win_interpolate(df, S, O, ["x"], anchors="all").collect()}
    assert full[dt.date(2009, 1, 5)] == pytest.approx(4 / 31)


def test_month_to_weeks_counter(spark):
    months = [dt.date(2009 + (i + 1) // 12, (i + 1) % 12 + 1, 1) for i in range(24)]
    df = spark.createDataFrame([("a", m) for m in months], "s string, t date")
    rows = month_to_weeks(df, S, O).toPandas()
    assert rows.groupby("t").size().tolist() == [5, 4, 4] * 8
    ordered = sorted(rows.itertuples(), key=lambda r: (r.t, (r.week - 5) % 52))
    assert [r.week for r in ordered] == [(4 + i) % 52 + 1 for i in range(104)]


def test_asof_last_n_against_brute_force(spark, frame):
    known = sorted((r.s or "", r.t, r.x) for r in frame.collect() if r.x is not None)
    readings = frame.na.fill({"s": ""})
    asked = [(k, o) for k in ("hot", "a", "b", "") for o in range(0, 2200, 97)]
    origins = spark.createDataFrame(asked, "s string, origin long")
    for limit in (None, 60):
        got = {(r.s, r.origin): r.history for r in joins.join_asof_last_n(
            origins, readings, S, O, "x", 12, max_rows=limit).collect()}
        for k, o in asked:
            before = [x for s, t, x in known if s == k and t <= o][::-1][:12]
            if len(before) == 12:
                assert got.pop((k, o)) == before
        assert not got


def test_acf_pacf_and_lag(spark):
    rng = np.random.default_rng(1)
    x = [0.0]
    for _ in range(299):
        x.append(0.7 * x[-1] + rng.normal())
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "s string, t int, x double")
    acf = ts.win_acf(df, S, O, "x", 10)
    got = {r.lag: r.acf for r in acf.collect()}
    c = np.array(x) - np.mean(x)
    want = [float((c[:len(c) - k] * c[k:]).sum() / (c * c).sum()) for k in range(11)]
    assert [got[k] for k in range(11)] == pytest.approx(want)
    # Solving the Yule-Walker equations of each order gives its last coefficient.
    pacf = {r.lag: r.pacf for r in ts.win_pacf(acf, S).collect()}
    for k in range(1, 11):
        toeplitz = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(toeplitz, want[1:k + 1])[-1])
    inside = [k for k in range(1, 11) if abs(want[k]) < 1.96 / np.sqrt(300)]
    assert ts.win_optimum_lag(acf, S, 10).first().optimum_lag == (inside[0] if inside else 10)


def test_asfreq_takes_the_last_row(spark):
    days = [(dt.date(2024, 1, d), float(d)) for d in (2, 6, 9, 25)]
    df = spark.createDataFrame([("a", d, v) for d, v in days], "s string, t date, x double")
    got = {r.t.day: r.x for r in reshape_asfreq(df, S, O).collect()}
    assert got == {7: 6.0, 14: 9.0, 21: 9.0}


@pytest.mark.parametrize("span", [1, 2, 5, 400])
def test_ewm_holds_over_null_runs_of_any_length(spark, span):
    rng = np.random.default_rng(span)
    x = [float(v) if rng.random() < 0.5 else None for v in rng.normal(size=5000)]
    x[:3] = [None, None, 1.5]
    x[100:700], x[900:4900] = [None] * 600, [None] * 4000
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "s string, t long, x double")
    want = pd.Series(x, dtype=float).ewm(span=span).mean()
    for m in (None, 300):
        got = ts.win_ewm(df, S, O, ["x"], span, max_rows=m).toPandas().sort_values("t")["x_EW"].to_numpy()
        np.testing.assert_allclose(got, want.to_numpy(), rtol=1e-9)
