"""Drift over the last N days: windows that move, late rows, replays, and the stream."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from featurewatch.operators import drift as D
from featurewatch.operators.drift_days import DayWindow, drift_last_days
from featurewatch.streaming import streams as S

T0 = dt.date(2024, 3, 1)


def _rows(spark, seed, days, n=300):
    rng = np.random.default_rng(seed)
    data = [(T0 + dt.timedelta(days=int(rng.integers(*days))), f"f{i % 3}", float(rng.integers(0, 40))) for i in range(n)]
    return data, spark.createDataFrame([*data, (None, "f0", 1.0), (T0, "f0", None)], "day date, feature string, value double")


def _counts(data, as_of, n):
    out = {}
    for day, f, v in data:
        if 0 <= (as_of - day).days < n:
            out[f, v] = out.get((f, v), 0) + 1
    return out


def test_windows_equal_the_rows_of_their_days(spark, tmp_path):
    window, seen = DayWindow(spark, str(tmp_path), 7), []
    steps = [(0, 5), (3, 12), (0, 12), (10, 30), (29, 30)]           # moves, late rows, a jump beyond the window, one day
    for batch, days in enumerate(steps):
        data, rows = _rows(spark, batch, days)
        seen += data
        for _ in range(2 if batch == 2 else 1):                       # the third batch is replayed
            window.add(rows, batch)
            got = window.advance(batch)
        as_of = max(d for d, *_ in seen)
        assert {(r.feature, r.value): r.n for r in got.collect()} == _counts(seen, as_of, 7)
    early = window.advance(len(steps) - 1, T0 + dt.timedelta(days=20))  # a window of the past
    assert {(r.feature, r.value): r.n for r in early.collect()} == _counts(seen, T0 + dt.timedelta(days=20), 7)


def test_only_months_with_changed_days_are_read(spark, tmp_path, monkeypatch):
    window, read = DayWindow(spark, str(tmp_path), 10), []
    for batch, days in enumerate([(0, 100), (100, 101)]):
        window.add(_rows(spark, batch, days, 600)[1], batch)
        if batch:                                                     # the plan of the second move
            inner = type(spark.range(1)).filter
            monkeypatch.setattr(type(spark.range(1)), "filter", lambda df, c: read.append(out := inner(df, c)) or out)
        counts = window.advance(batch)
    monkeypatch.undo()
    folders = [r for r in read if "month" in r.columns][1]              # after the filter on batches, the one on folders
    assert {(r.batch, r.month) for r in folders.select("batch", "month").distinct().collect()} == {(0, "2024-05"), (0, "2024-06"), (1, "2024-06"), (1, "2024-05")} & {
        (r.batch, r.month) for r in spark.read.parquet(f"{tmp_path}/days").select("batch", "month").distinct().collect()}
    assert "PartitionFilters: [" in folders._jdf.queryExecution().executedPlan().toString() and counts.count() > 0


def test_report_equals_the_batch_report_of_these_days(spark, tmp_path):
    ref = spark.range(900).select(F.concat(F.lit("f"), F.col("id") % 3).alias("feature"), F.lit(D.REF).alias("side"), (F.col("id") * 7 % 37).cast("double").alias("value"))
    batches, seen = [], []
    for i, days in enumerate([(0, 9), (5, 15)]):
        data, rows = _rows(spark, 10 + i, days)
        seen += data
        batches.append(rows.unionByName(spark.createDataFrame([(T0, "unknown", 1.0)], rows.schema)))
    as_of = max(d for d, *_ in seen)
    prod = [(f, D.PROD, v) for d, f, v in seen if (as_of - d).days < 6]
    want = D.drift_report(ref.unionByName(spark.createDataFrame(prod, "feature string, side string, value double")))
    got = drift_last_days(ref, batches, 6, str(tmp_path / "a"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3

    src = str(tmp_path / "in")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = S.drift_over_days(stream, ref, lambda b: b, 6, root=str(tmp_path / "q"))
    last = out.filter("batch_id = 1").drop("batch_id")
    assert sorted(map(str, last.collect())) == sorted(map(str, want.collect())) and out.select("batch_id").distinct().count() == 2
