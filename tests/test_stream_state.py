"""State between micro-batches: several batches, restart from the checkpoint, replayed batches, last call wins."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from featurewatch.operators import concept as CD
from featurewatch.operators.asof import latest_per_key
from featurewatch.operators.drift import PROD, REF
from featurewatch.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def _write(df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)                                        # files are taken in order of their time


def _stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_concept_windows_over_uneven_batches_and_a_restart(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/q"
    rows = [(i, i % 3 == 0, i % 4 == 0) for i in range(95)]
    df = spark.createDataFrame([("m", i, int(a), int(b)) for i, a, b in rows], "model string, seq long, y int, p int")
    cuts = [0, 25, 40, 60, 61, 95]                         # the open window is empty after 40 and 60 rows
    run = lambda: S.concept_windows(_stream(spark, df.schema, src), "model", "seq", "y", "p", root=root)
    for a, b in zip(cuts[:3], cuts[1:4], strict=True):
        _write(df.filter((F.col("seq") >= a) & (F.col("seq") < b)), src)
    first = run().collect()
    assert sorted((r.start_seq, r.end_seq) for r in first) == [(0, 19), (20, 39), (40, 59)]
    for a, b in zip(cuts[3:-1], cuts[4:], strict=True):
        _write(df.filter((F.col("seq") >= a) & (F.col("seq") < b)), src)
    got = sorted((r.window_index, r.tp, r.fp, r.fn, r.tn, r.f1, r.start_seq, r.end_seq) for r in run().collect())
    want = CD.concept_windows(df, "seq", "y", "p").filter("n = 20").collect()
    assert got == sorted((r.window_index, r.tp, r.fp, r.fn, r.tn, r.f1, r.start_time, r.end_time) for r in want)
    assert len(got) == 4


def test_state_errors_are_not_taken_for_an_empty_state(spark, tmp_path):
    assert S.state_before(spark, f"{tmp_path}/none", 0, "a int").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.state_before(spark, f"{tmp_path}/none", 3, "a int").count()


def test_materialize_rewrites_touched_parts_and_survives_a_replay(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/q"
    schema = "k string, ts timestamp_ntz, v long"
    df = spark.createDataFrame([(f"k{i % 7}", T0 + dt.timedelta(hours=(i * 37) % 100), i) for i in range(60)], schema)
    for a in range(0, 60, 12):
        _write(df.filter((F.col("v") >= a) & (F.col("v") < a + 12)), src)
    run = lambda: S.materialize_stream(_stream(spark, df.schema, src), "k", "ts", ["v"], "v", root=root, parts=5)
    want = sorted(map(tuple, latest_per_key(df, "k", "ts", ["v"], "v").collect()))
    assert sorted(map(tuple, run().collect())) == want
    (tmp_path / "q/_checkpoint/commits/4").unlink()        # the last batch did not commit: it is replayed
    crc = tmp_path / "q/_checkpoint/commits/.4.crc"
    if crc.exists():
        crc.unlink()
    assert sorted(map(tuple, run().collect())) == want
    one = spark.createDataFrame([("k1", T0 + dt.timedelta(days=99), 1000)], schema)
    _write(one, src)
    got = run()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, latest_per_key(df.unionByName(one), "k", "ts", ["v"], "v").collect()))
    written = [p.name for p in (tmp_path / "q/data/v=5").iterdir() if p.name.startswith("part=")]
    assert len(written) == 1


def test_drift_reports_once_per_batch_even_when_replayed(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/q"
    ref = spark.createDataFrame([("a", REF, float(i)) for i in range(50)], "feature string, side string, value double")
    prod = spark.createDataFrame([("a", PROD, float(i)) for i in range(40)] + [("new", PROD, 1.0)] * 9, ref.schema)
    for a in (0, 20):
        _write(prod.filter((F.col("value") >= a) & (F.col("value") < a + 20)), src)
    run = lambda: S.drift_per_batch(_stream(spark, ref.schema, src), ref, lambda b: b, root=root)
    rows = sorted((r.batch_id, r.feature, r.n_production) for r in run().collect())
    assert rows == [(0, "a", 20), (1, "a", 20)]
    for f in (tmp_path / "q/_checkpoint/commits").glob("*1*"):
        f.unlink()
    assert sorted((r.batch_id, r.feature, r.n_production) for r in run().collect()) == rows


def test_last_feedback_call_wins(spark):
    df = spark.createDataFrame([("p", T0, 1, 0, T0, 1), ("p", T0, 1, 1, T0, 2), ("q", T0, 0, None, None, None)],
                               "prediction_id string, timestamp timestamp, prediction int, actual_outcome int, feedback_timestamp timestamp, fb_seq long")
    assert sorted((r.prediction_id, r.actual_outcome) for r in S.latest_outcomes(df).collect()) == [("p", 1), ("q", None)]


def test_concept_windows_of_a_null_model_over_three_batches(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/q"
    df = spark.createDataFrame([(m, 2 * i + (m is None), i % 3 % 2, i % 4 % 2) for i in range(63) for m in ("m", None)], "model string, seq long, y int, p int")
    for a, b in ((0, 50), (50, 90), (90, 126)):            # 25, 20 and 18 rows a model
        _write(df.filter((F.col("seq") >= a) & (F.col("seq") < b)), src)
    got = S.concept_windows(_stream(spark, df.schema, src), "model", "seq", "y", "p", root=root).collect()
    want = CD.concept_windows(df, "seq", "y", "p", groups=["model"]).filter("n = 20").collect()
    assert sorted((str(r.model), r.window_index, r.f1, r.start_seq, r.end_seq) for r in got) == sorted(
        (str(r.model), r.window_index, r.f1, r.start_time, r.end_time) for r in want)
    assert [r.window_index for r in sorted(got, key=lambda r: r.window_index) if r.model is None] == [0, 1, 2]
    counters = spark.read.parquet(f"{root}/_state/counters/v=2").collect()
    assert sorted((str(r.model), r.n_windows) for r in counters) == [("None", 3), ("m", 3)]


def test_drift_per_batch_deals_no_rows_by_feature(spark, tmp_path, monkeypatch):
    from featurewatch.operators import drift
    ref = spark.createDataFrame([("x", "reference", float(i)) for i in range(20)], "feature string, side string, value double")
    ref.withColumn("side", F.lit("production")).unionByName(spark.createDataFrame([("y", "production", 1.0)], ref.schema)).coalesce(1).write.parquet(f"{tmp_path}/src")
    plans, report = [], drift.report_from_reduced
    monkeypatch.setattr(drift, "report_from_reduced", lambda both, *a: (plans.append(both._jdf.queryExecution().executedPlan().toString()), report(both, *a))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # a reference too large to be broadcast unasked
    try:
        got = S.drift_per_batch(_stream(spark, ref.schema, f"{tmp_path}/src"), ref, lambda b: b, root=f"{tmp_path}/q").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r.feature, r.n_production) for r in got] == [("x", 20)]
    assert plans and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
