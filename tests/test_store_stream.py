"""Feature store (as-of retrieval with TTL, materialise, ingest), concept
windows and stream = batch checks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurewatch.operators import asof as A
from featurewatch.operators import concept as CD
from featurewatch.sources import feature_store as FS

T0 = dt.datetime(2023, 1, 1)


def _ts(days, secs=0):
    return T0 + dt.timedelta(days=days, seconds=secs)


@pytest.fixture(scope="module")
def fixture_f3(spark):
    """Several event times per key, an exact tie, a row after the entity time,
    one exactly 365 days old and one 365 days + 1 s old, a key with no rows."""
    feats = [
        ("k1", _ts(0), 1, 10.0), ("k1", _ts(10), 2, 11.0), ("k1", _ts(10), 3, 12.0),   # tie -> larger id wins
        ("k1", _ts(50), 4, 13.0),                                                      # after entity time
        ("k2", _ts(0), 5, 20.0),                                                       # exactly 365 days old
        ("k3", _ts(0, -1), 6, 30.0),                                                   # 365 days + 1 s old
        ("k4", _ts(100), 7, 40.0), ("k4", _ts(400), 8, 41.0),                           # crosses many buckets
    ]
    f = spark.createDataFrame(feats, "key string, ts timestamp_ntz, id long, v double")
    ents = [("e1", "k1", _ts(20)), ("e2", "k2", _ts(365)), ("e3", "k3", _ts(365)), ("e4", "k5", _ts(5)),
            ("e5", "k1", _ts(10)), ("e6", "k4", _ts(399)), ("e7", "k4", _ts(401)), ("e8", "k1", _ts(-1))]
    e = spark.createDataFrame(ents, "eid string, key string, t timestamp_ntz")
    return f, e


EXPECTED = {"e1": 12.0, "e2": 20.0, "e3": None, "e4": None, "e5": 12.0, "e6": 40.0, "e7": 41.0, "e8": None}


@pytest.mark.parametrize("plan", ["range", "union"])
def test_asof_ttl_semantics(spark, fixture_f3, plan):
    f, e = fixture_f3
    view = A.ViewInput("v", f, "key", "ts", ["v"], tiebreak="id", ttl_days=365)
    out = (A.asof_join_range(e, "key", "t", ["eid"], view) if plan == "range"
           else A.asof_join_union(e, "key", "t", [view], bucket_days=7))
    got = {r.eid: r.v for r in out.collect()}
    assert got == EXPECTED


def test_asof_multi_view_one_pass(spark, fixture_f3):
    f, e = fixture_f3
    v1 = A.ViewInput("v", f, "key", "ts", ["v"], tiebreak="id", ttl_days=365)
    v2 = A.ViewInput("w", f.withColumn("v2", F.col("v") * 2), "key", "ts", ["v2"], tiebreak="id",
                     ttl_days=None, prefix="w_")
    out = {r.eid: r for r in A.asof_join_union(e, "key", "t", [v1, v2], bucket_days=30).collect()}
    assert out["e3"].v is None and out["e3"].w_v2 == 60.0      # no TTL on the second view
    assert out["e1"].v == 12.0 and out["e1"].w_v2 == 24.0


@pytest.mark.parametrize("plan", ["range", "union"])
def test_asof_null_keys_dense_keys_and_text_ties(spark, plan):
    feats = [("a", _ts(1), "x", 1.0), ("a", _ts(1), "y", 2.0), ("a", None, "z", 9.0), (None, _ts(1), "x", 99.0)]
    feats += [("dense", _ts(i / 50), f"{i:05d}", float(i)) for i in range(3000)]
    f = spark.createDataFrame(feats, "key string, ts timestamp_ntz, tie string, v double")
    ents = [(1, "a", _ts(2)), (2, None, _ts(2)), (3, "a", None), (4, "dense", _ts(30)), (5, "dense", _ts(59.99)), (6, "dense", _ts(500))]
    e = spark.createDataFrame(ents + [(100 + i, None, _ts(i)) for i in range(50)], "eid int, key string, t timestamp_ntz")
    for ttl in (365, None):
        view = A.ViewInput("v", f, "key", "ts", ["v"], tiebreak="tie", ttl_days=ttl)
        out = A.asof_join_range(e, "key", "t", ["eid"], view) if plan == "range" else A.asof_join_union(e, "key", "t", [view])
        got = {r.eid: r.v for r in out.collect()}
        assert got == {1: 2.0, 2: None, 3: None, 4: 1500.0, 5: 2999.0, 6: None if ttl else 2999.0} | {100 + i: None for i in range(50)}


@pytest.mark.parametrize("ttl", [3, 365, None])
def test_asof_heavy_buckets_are_cut_with_equal_results(spark, ttl):
    f = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
                                 (F.lit(_ts(0)) + F.make_dt_interval(F.pmod(F.xxhash64("id"), F.lit(70)).cast("int"), F.pmod(F.col("id"), F.lit(24)).cast("int"))).alias("ts"),
                                 F.col("id"), (F.col("id") * 1.0).alias("v"))
    e = spark.range(3000).select(F.col("id").alias("eid"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 45)).alias("key"),
                                 F.when(F.col("id") % 70 != 2, F.lit(_ts(-5)) + F.make_dt_interval(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("int"), F.lit(0), F.lit(0), F.lit(1.5))).alias("t"))
    views = [A.ViewInput("v", f, "key", "ts", ["v"], tiebreak="id", ttl_days=ttl),
             A.ViewInput("w", f.filter("id % 7 = 0 or (key = 'hot' and id < 30)"), "key", "ts", ["v"], tiebreak="id", ttl_days=ttl, prefix="w_")]
    plain = A.asof_join_union(e, "key", "t", views, heavy_rows=None)
    for heavy in (100, 7):
        cut = A.asof_join_union(e, "key", "t", views, heavy_rows=heavy)
        assert cut.count() == 3000 and cut.exceptAll(plain).count() == 0
    one = A.asof_join_range(e.withColumn("x", F.lit(1)), "key", "t", ["eid"], views[0]).drop("x")
    assert plain.select(e.columns + ["v", "feature_ts"]).exceptAll(one).count() == 0


def test_asof_hot_key_within_one_month_is_dealt_over_tasks(spark):
    """A third of all rows belong to one key and one month: the rows of each task of the sort are read from the plan's result."""
    f = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
                                 (F.lit(_ts(2)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * 60)).alias("ts"), F.col("id").alias("v"))
    e = f.select(F.col("v").alias("eid"), "key", F.col("ts").alias("t"))
    view = A.ViewInput("v", f, "key", "ts", ["v"], tiebreak="v")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        largest = lambda df: max(r["count"] for r in df.filter("key = 'hot' and v is not null").groupBy(F.spark_partition_id()).count().collect())
        assert largest(A.asof_join_union(e, "key", "t", [view], heavy_rows=None)) == 3000
        assert largest(A.asof_join_union(e, "key", "t", [view], heavy_rows=150)) <= 900
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_latest_and_online_lookup(spark, fixture_f3):
    f, _ = fixture_f3
    latest = A.latest_per_key(f, "key", "ts", ["v", "id"], tiebreak="id")
    got = {r.key: r.v for r in latest.collect()}
    assert got == {"k1": 13.0, "k2": 20.0, "k3": 30.0, "k4": 41.0}
    ids = spark.createDataFrame([("k1",), ("k9",)], "key string")
    res = {r.key: (r.found, r.v) for r in A.online_lookup(ids, "key", latest).collect()}
    assert res == {"k1": (True, 13.0), "k9": (False, None)}


def test_ingest_materialize_incremental(spark, fixture_f3):
    f, _ = fixture_f3
    view = FS.FeatureView("v", FS.EntityDef("thing", "thing_id"),
                          T.StructType([T.StructField("v", T.DoubleType()), T.StructField("id", T.LongType()),
                                        T.StructField("absent", T.DoubleType())]))
    t = FS.ingest_view(f, view, "key", "ts")
    assert t.columns == ["thing_id", "event_timestamp", "v", "id", "event_date"]
    with pytest.raises(ValueError):
        FS.ingest_view(f, view, "nokey", "ts")
    full = FS.materialize(t, "thing_id", tiebreak="id")
    snap = FS.materialize(t, "thing_id", end=_ts(20), tiebreak="id")
    inc = FS.materialize_incremental(snap, t, "thing_id", _ts(20), tiebreak="id")
    assert sorted(full.collect()) == sorted(inc.select(*full.columns).collect())
    path = FS.write_view(spark, view.name, t, mode="overwrite", key="thing_id")
    back = FS.read_view(spark, view, start=_ts(5), end=_ts(60))
    assert back.count() == 3 and path.endswith("views/v")
    chk = {r.column: r for r in FS.schema_check(back, "v", view.schema).collect()}
    assert chk["absent"].present is False and chk["v"].n_uncastable == 0


def test_concept_windows_match_python(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(87)]
    df = spark.createDataFrame(rows, "seq long, y int, p int")
    w = CD.concept_windows(df, "seq", "y", "p", buckets=4).orderBy("window_index").collect()
    assert [r.n for r in w] == [20, 20, 20, 20, 7]
    chunk = rows[20:40]
    tp = sum(1 for _, y, p in chunk if y == 1 and p == 1)
    assert w[1].tp == tp and w[1].label == "W2" and w[1].start_time == 20 and w[1].end_time == 39
    v = CD.concept_verdict(CD.concept_windows(df, "seq", "y", "p"), df).first()
    f1s = [r.f1 for r in w]
    assert v.latest_f1 == f1s[-1] and v.baseline_f1 == pytest.approx(round(sum(f1s[:-1]) / 4, 4), abs=1e-4)
    short = CD.concept_verdict(CD.concept_windows(df.limit(3), "seq", "y", "p"), df.limit(3)).first()
    assert short.status == "INSUFFICIENT_DATA"


def test_stream_equals_batch_on_closed_windows(spark):
    from featurewatch.operators.log_stats import throughput_series
    from featurewatch.plans.roles import log_from_events, prediction_log
    from featurewatch.streaming import streams as S
    d = "/root/testdata/sf0.001"
    st = S.run_available(S.throughput(log_from_events(S.table_stream(spark, d, "events")), "1 day"), "t_test")
    batch = throughput_series(prediction_log(spark, d), 24 * 60)
    newest = prediction_log(spark, d).agg(F.max("timestamp")).first()[0]
    closed = batch.filter(F.col("window_end") <= F.lit(newest - dt.timedelta(hours=1)))
    s = sorted((r.window_start.replace(tzinfo=None), r.requests) for r in st.collect())
    b = sorted((r.window_start, r.requests) for r in closed.collect())
    assert s == b and len(s) > 0


def test_stream_concept_state_equals_batch_full_windows(spark):
    from featurewatch.streaming import streams as S
    d = "/root/testdata/sf0.001"
    lab = S.table_stream(spark, d, "labels").withColumn("model", F.lit("m"))
    st = S.concept_windows(lab, "model", "doc_id", "toxic", "quality", name="c_test")
    batch = CD.concept_windows(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "toxic", "quality")
    full = batch.filter(F.col("n") == 20)
    assert sorted((r.window_index, r.tp, r.f1) for r in st.collect()) == \
        sorted((r.window_index, r.tp, r.f1) for r in full.collect())


def test_stream_concept_carries_state_across_batches(spark, tmp_path):
    import time
    from featurewatch.streaming import streams as S
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    src = str(tmp_path / "labels_in")
    for lo, hi in ((0, 300), (300, 650), (650, 10**9)):       # three files, in arrival order
        lab.filter((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = (spark.readStream.schema(lab.schema).option("maxFilesPerTrigger", 1).parquet(src)
              .withColumn("model", F.lit("m")))
    st = S.concept_windows(stream, "model", "doc_id", "toxic", "quality", name="c_multi")
    assert st.select("batch").distinct().count() == 3 if "batch" in st.columns else True
    batch = CD.concept_windows(lab, "doc_id", "toxic", "quality").filter(F.col("n") == 20)
    got = sorted((r.window_index, r.tp, r.fp, r.fn, r.tn, r.start_seq, r.end_seq) for r in st.collect())
    exp = sorted((r.window_index, r.tp, r.fp, r.fn, r.tn, r.start_time, r.end_time) for r in batch.collect())
    assert got == exp and len(got) == 19
    # baseline of the last window = mean F1 of all earlier windows
    rows = sorted(st.collect(), key=lambda r: r.window_index)
    assert rows[-1].baseline_f1 == pytest.approx(round(sum(r.f1 for r in rows[:-1]) / 18, 4), abs=1e-4)


def test_asof_plans_agree_under_hot_key(spark):
    """A third of all rows on one key: both plans agree row for row, and the
    union plan spreads the hot key over many (key, time bucket) partitions."""
    n = 6000
    base = F.lit(T0).cast("timestamp_ntz")

    def key(c):
        return F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))

    f = spark.range(n).select(key("id").alias("key"), (base + F.make_dt_interval(F.col("id") % 900)).alias("ts"),
                              F.col("id").alias("fid"), (F.col("id") * 1.5).alias("v"))
    e = spark.range(n).select(F.col("id").alias("eid"), key("id").alias("key"),
                              (base + F.make_dt_interval((F.col("id") * 7) % 1000)).alias("t"))
    view = A.ViewInput("v", f, "key", "ts", ["v"], tiebreak="fid", ttl_days=90)
    r = A.asof_join_range(e, "key", "t", ["eid"], view).select("eid", "v", "feature_ts")
    u = A.asof_join_union(e, "key", "t", [view], bucket_days=30).select("eid", "v", "feature_ts")
    assert r.exceptAll(u).count() == 0 and u.exceptAll(r).count() == 0 and u.count() == n
    hot_buckets = (f.filter(F.col("key") == "hot")
                   .select(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (30 * 86400))).distinct().count())
    assert hot_buckets >= 25


def test_a_busy_day_of_the_log_is_written_by_several_tasks(spark):
    import uuid

    from featurewatch.operators import log_stats

    rows = log_stats.build_log(spark.range(2000), F.col("id").cast("string"), F.col("id"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"), F.lit(1), F.lit(0.5))
    name = uuid.uuid4().hex
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log_stats.append_log(spark, rows, name)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    log = log_stats.read_log(spark, name)
    assert log.count() == 2000 and log.select(F.input_file_name()).distinct().count() > 1


def test_late_rows_reach_the_snapshot_by_the_list_of_files(spark):
    import uuid
    view = FS.FeatureView(f"late_{uuid.uuid4().hex}", FS.EntityDef("thing", "thing_id"), T.StructType([T.StructField("v", T.DoubleType()), T.StructField("id", T.LongType())]))
    schema = "key string, ts timestamp_ntz, id long, v double"
    first = spark.createDataFrame([("a", _ts(10), 1, 1.0), ("b", _ts(50), 2, 2.0), ("c", _ts(40), 3, 3.0), ("d", _ts(90), 9, 9.0)], schema)
    # late: newer than a's value, older than b's, a new key; in time: newer than all
    second = spark.createDataFrame([("a", _ts(20), 4, 4.0), ("b", _ts(30), 5, 5.0), ("z", _ts(5), 6, 6.0), ("c", _ts(95), 7, 7.0)], schema)
    publish = lambda **kw: {r.thing_id: r.v for r in FS.publish(spark, view, FS.read_view(spark, view), tiebreak="id", days=None, **kw).collect()}
    FS.write_view(spark, view.name, FS.ingest_view(first, view, "key", "ts"), key="thing_id")
    assert publish(end=_ts(60), late_rows=True) == {"a": 1.0, "b": 2.0, "c": 3.0}
    FS.write_view(spark, view.name, FS.ingest_view(second, view, "key", "ts"), key="thing_id")
    assert publish(end=_ts(100), late_rows=True) == {"a": 4.0, "b": 2.0, "c": 7.0, "d": 9.0, "z": 6.0}
    assert publish(end=_ts(100), late_rows=True) == {"a": 4.0, "b": 2.0, "c": 7.0, "d": 9.0, "z": 6.0}
    # the reference's rule passes late rows over
    other = FS.FeatureView(view.name + "_r", view.entity, view.schema)
    FS.write_view(spark, other.name, FS.ingest_view(first, other, "key", "ts"), key="thing_id")
    FS.publish(spark, other, FS.read_view(spark, other), end=_ts(60), tiebreak="id", days=None)
    FS.write_view(spark, other.name, FS.ingest_view(second, other, "key", "ts"), key="thing_id")
    got = {r.thing_id: r.v for r in FS.publish(spark, other, FS.read_view(spark, other), end=_ts(100), tiebreak="id", days=None).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": 7.0, "d": 9.0}


def test_asof_copies_no_rows_of_keys_with_few_rows(spark):
    f = spark.range(400).select(F.concat(F.lit("k"), F.col("id") % 40).alias("key"), (F.lit(_ts(0)) + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"), F.col("id").alias("v"))
    e = f.select(F.col("v").alias("eid"), "key", (F.col("ts") + F.make_dt_interval(F.lit(200))).alias("t"))
    view = A.ViewInput("v", f, "key", "ts", ["v"], tiebreak="v")
    out = A.asof_join_union(e, "key", "t", [view])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.exceptAll(A.asof_join_union(e, "key", "t", [view], heavy_rows=None)).count() == 0 and out.count() == 400
    # one key has many rows: it alone is split by time
    hot = f.unionByName(spark.range(300).select(F.lit("hot").alias("key"), (F.lit(_ts(0)) + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"), (F.col("id") + 1000).alias("v")))
    view = A.ViewInput("v", hot, "key", "ts", ["v"], tiebreak="v")
    e = hot.select(F.col("v").alias("eid"), "key", (F.col("ts") + F.make_dt_interval(F.lit(45))).alias("t"))
    out = A.asof_join_union(e, "key", "t", [view], heavy_rows=100)
    assert "Generate" in out._jdf.queryExecution().executedPlan().toString()
    assert out.exceptAll(A.asof_join_union(e, "key", "t", [view], heavy_rows=None)).count() == 0 and out.count() == 700
