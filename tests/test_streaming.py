import datetime as dt

from pyspark.sql import functions as F

from tidemill.streaming import sensor
from tidemill.sources.upsert import Folder, Run, keep_first, merge_keyed, read_keyed, read_recent


def hours(n, start=dt.datetime(2024, 3, 1)):
    return [("a", start + dt.timedelta(hours=i), float((i * 7) % 24)) for i in range(n)]


SCHEMA = "series string, time timestamp, elec_prices_metric double"


def test_backfill_origins_and_offsets(spark):
    df = spark.createDataFrame(hours(160), SCHEMA)
    rows = sensor.st_backfill(df, ["series"], "time", "elec_prices_metric").orderBy("origin").collect()
    first = dt.datetime(2024, 3, 1) + dt.timedelta(hours=100)
    assert [r.origin for r in rows] == [first + dt.timedelta(hours=24 * i) for i in range(3)]
    assert rows[0].history == [float((i * 7) % 24) for i in range(100, 0, -1)]
    nxt = first + dt.timedelta(days=1)
    assert (rows[0].day_of_week, rows[0].day_of_year, rows[0].week_of_year) == (
        nxt.weekday(), nxt.timetuple().tm_yday, nxt.isocalendar()[1])


def test_the_training_range_is_a_year_that_ends_a_quarter_before_now(spark):
    now = dt.datetime(2025, 6, 1)
    lo, hi = sensor.training_range(now)
    assert hi - lo == dt.timedelta(days=365) and now - hi == dt.timedelta(days=365 / 4)
    df = spark.createDataFrame(hours(400, lo) + hours(300, hi + dt.timedelta(days=1)), SCHEMA)
    named = sensor.st_retrain(df, ["series"], "time", "elec_prices_metric", lo, hi)
    assert sensor.st_retrain(df, ["series"], "time", "elec_prices_metric", now=now) == named
    assert sensor.st_retrain(df, ["series"], "time", "elec_prices_metric", now=lo) is None


def test_too_few_rows_give_no_model(spark):
    df = spark.createDataFrame(hours(99), SCHEMA)
    assert sensor.st_retrain(df, ["series"], "time", "elec_prices_metric", dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)) is None


def test_rolling_loop_keeps_first_values(spark, tmp_path):
    rows = hours(400)
    train = spark.createDataFrame(rows, SCHEMA)
    model = sensor.st_retrain(train, ["series"], "time", "elec_prices_metric", dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    for part in (rows[:200], [("a", rows[199][1], -1.0), *rows[200:230]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = sensor.st_source(spark, source, SCHEMA, time_col="time")
        sensor.run_rolling_forecast(stream, path, str(tmp_path / "ck"), model, ["series"], available_now=True).awaitTermination()
    got = {r.time: (r.elec_prices_metric, r.elec_prices) for r in read_keyed(spark, path).collect()}
    assert {t: v[0] for t, v in got.items() if v[0] is not None} == {t: x for _, t, x in rows[:230]}
    forecasts = {t for t, v in got.items() if v[1] is not None}
    first, second = rows[199][1], rows[229][1]
    assert forecasts == {o + dt.timedelta(hours=i) for o in (first, second) for i in range(24)}
    # The values repeat every 24 hours, so a fitted model forecasts them.
    assert all(abs(got[t][1] - (int((t - dt.datetime(2024, 3, 1)).total_seconds() // 3600) * 7) % 24) < 0.5 for t in forecasts)


def test_late_rows_and_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(hours(50), SCHEMA).union(spark.createDataFrame(hours(50), SCHEMA)).write.parquet(source)
    stream = sensor.st_late(sensor.st_source(spark, source, SCHEMA, time_col="time"), ["series", "time"], "time")
    out = str(tmp_path / "out")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
    sensor.st_hourly(writer, available_now=True).start().awaitTermination()
    assert spark.read.parquet(out).agg(F.count("*")).first()[0] == 50


def test_merges_write_only_their_own_rows_and_old_runs_go(spark, tmp_path):
    path, key, cols = str(tmp_path / "table"), ["series", "time"], ["a", "b"]
    schema = "series string, time timestamp, a double, b double, seq long"
    start = dt.datetime(2024, 3, 1)
    batches, seq = [], 0
    for n in range(10):
        rows = []
        for i in range(30):
            seq += 1
            at = start + dt.timedelta(hours=(n * 17 + i * 5) % 120)
            rows.append((None if i % 11 == 0 else "s", at, None if (i + n) % 3 else float(seq), None if i % 2 else -float(seq), seq))
        batches.append([*rows, ("s", None, 1.0, 1.0, 0)])
    folder = Folder(spark, path)
    for n, rows in enumerate(batches):
        before = {r.name for r in folder.runs()[0]}
        batch = spark.createDataFrame(rows, schema)
        merge_keyed(batch, path, key, cols, "time", "seq", fan=3)
        merge_keyed(batch, path, key, cols, "time", "seq", fan=3)
        live, stale = folder.runs()
        assert len(live) <= 6 and len(stale) <= 7
        if n == 0:
            assert [r.level for r in live] == [0, 0]
            keys = {(s, t) for s, t, *_ in rows if t is not None}
            assert folder.read(live[:1]).count() == len(keys)
        assert before != {r.name for r in live}
    assert [r.level for r in folder.runs()[0]] == [2, 2, 0, 0]
    known = spark.createDataFrame([r for b in batches for r in b], schema).filter("time IS NOT NULL")
    want = {tuple(r) for r in keep_first(known, key, cols, ["seq"]).collect()}
    assert {tuple(r) for r in read_keyed(spark, path).collect()} == want
    day = (start + dt.timedelta(days=3)).date()
    assert {tuple(r) for r in read_recent(spark, path, day).collect()} == {r for r in want if r[1].date() >= day}
    # what a lost writer leaves behind does not count, and goes with the next merge
    lost = Run(1, 20, 3)
    folder.write(folder.read(folder.runs()[0][:1]).select("_key", "_value", "part_date").limit(1), lost)
    folder._fs.delete(folder._at(f"{path}/{lost.name}/_SUCCESS"), False)
    assert {tuple(r) for r in read_keyed(spark, path).collect()} == want
    merge_keyed(spark.createDataFrame(batches[0], schema).limit(0), path, key, cols, "time", "seq", fan=3)
    assert {tuple(r) for r in read_keyed(spark, path).collect()} == want
    assert lost not in folder.runs()[1]
