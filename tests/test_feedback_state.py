"""T5 with keyed state: order of arrival, last call, deadlines, restart and replay."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurewatch.streaming import feedback_state as FB
from featurewatch.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)
LOG, CALLS = "prediction_id string, timestamp timestamp_ntz, prediction int", "prediction_id string, outcome int, feedback_timestamp timestamp_ntz, fb_seq long"


def at(days, hours=0):
    return T0 + dt.timedelta(days=days, hours=hours)


@pytest.fixture
def query(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", FB.ROCKSDB)
    for name, schema in (("log", LOG), ("calls", CALLS)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{tmp_path}/{name}")

    def add(name, rows):
        spark.createDataFrame(rows, LOG if name == "log" else CALLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        time.sleep(1.1)

    def run():
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        out = S.run_available(FB.final_outcomes(read("log", LOG), read("calls", CALLS), max_delay_days=10, delay="5 days"), "final", root=f"{tmp_path}/q")
        return sorted((r.prediction_id, r.prediction, r.actual_outcome, r.feedback_timestamp) for r in out.withColumn("feedback_timestamp", F.col("feedback_timestamp").cast("timestamp_ntz")).collect())

    yield add, run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_last_call_wins_over_batches_and_restarts(query):
    add, run = query
    add("log", [("a", at(0), 1), ("b", at(1), 0), ("c", at(2), 1), ("late", at(3), 1)])
    add("calls", [("a", 0, at(2), 1), ("a", 1, at(1), 2), ("early", 1, at(4), 3)])
    assert run() == []                                                    # no deadline has passed
    add("calls", [("a", 1, at(2), 9), ("b", 1, at(11), 4), ("c", 0, at(13), 5)])
    # a: of two calls at one time the later one; b: a call at the deadline counts; c: a call after it does not
    add("log", [("early", at(4), 0), ("a", at(5), 0)])                    # a call came before its prediction; a repeated id
    assert run() == []                                                    # the watermark is five days behind
    add("log", [("mid", at(16), 1)])
    assert run() == [("a", 1, 1, at(2))]
    add("log", [("far", at(60), 1)])
    got = run()
    assert got == [("a", 1, 1, at(2)), ("b", 0, 1, at(11)), ("c", 1, None, None), ("early", 0, 1, at(4)), ("late", 1, None, None), ("mid", 1, None, None)]
    add("calls", [("late", 1, at(5), 8)])                                 # too late: its row is out
    assert run() == got


def test_a_replayed_batch_writes_the_same_rows(query, tmp_path):
    add, run = query
    add("log", [(f"p{i}", at(i / 10), i % 2) for i in range(50)])
    add("calls", [(f"p{i}", 1, at(i / 10 + 1), i) for i in range(0, 50, 3)])
    add("log", [("far", at(40), 1)])
    want = run()
    assert len(want) == 50 and sum(o is not None for _, _, o, _ in want) == 17
    commits = sorted((tmp_path / "q/_checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()                                                  # the last batch did not commit
    crc = commits[-1].with_name(f".{commits[-1].name}.crc")
    if crc.exists():
        crc.unlink()
    assert run() == want


def test_state_is_kept_by_bucket_not_by_id(spark, query, tmp_path):
    add, _ = query
    add("log", [(f"p{i}", at(i / 1000), i % 2) for i in range(2000)])
    add("calls", [(f"p{i}", 1, at(i / 1000 + 1), i) for i in range(0, 2000, 3)])
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    out = FB.final_outcomes(read("log", LOG), read("calls", CALLS), max_delay_days=10, buckets=8)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/o")
    q.awaitTermination()
    assert max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= 8 * 8


def test_settle_equals_taking_calls_one_by_one():
    rng, delay = random.Random(3), 50
    for _ in range(50):
        rows = [(f"p{rng.randrange(6)}", rng.random() < 0.7, rng.randrange(200), rng.choice([None, *range(5)]), rng.randrange(10_000), rng.randrange(3)) for _ in range(40)]
        frame = pd.DataFrame(rows, columns=["prediction_id", "is_call", "at", "seq", "value", "chunk"]).astype({"seq": "Int64", "value": "Int32"})
        logged, waiting = FB.settle(frame, delay)
        want, left = {}, []
        for key in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == key]
            predictions = sorted((chunk, t, v) for _, is_call, t, _, v, chunk in own if not is_call)
            calls = [(t, -1 if s is None else s, v) for _, is_call, t, s, v, _ in own if is_call]
            if predictions:
                _, t, v = predictions[0]
                most = max(((a, s) for a, s, _ in calls if t <= a <= t + delay), default=None)
                want[key] = (t, v, most and {c[2] for c in calls if c[:2] == most})
            else:
                left += [(key, c[0]) for c in calls]
        got = {r.prediction_id: (r.at, r.value, None if pd.isna(r.outcome) else r.outcome) for r in logged.itertuples()}
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert all(got[k][2] in o if o else got[k][2] is None for k, (_, _, o) in want.items())
        assert sorted(zip(waiting.prediction_id, waiting.call_at, strict=True)) == sorted(left)
