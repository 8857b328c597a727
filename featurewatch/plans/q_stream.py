"""Streaming queries (T1-T8): each runs a Structured Streaming query with
``Trigger.AvailableNow`` over the input table as a file stream and returns
the sink.  Window results are compared with the batch definition on CLOSED
windows (window end <= newest event time - watermark delay)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurewatch.operators.drift import PROD, REF
from featurewatch.plans.roles import DRIFT_FEATURES, FEEDBACK_SQL, LOG_SQL, drift_long, feedback_from_events, log_from_events
from featurewatch.sources import feature_store as FS
from featurewatch.streaming import feedback_state as FB
from featurewatch.streaming import streams as S

Q, SQL = {}, {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _log_stream(spark, d):
    return log_from_events(S.table_stream(spark, d, "events"))


CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@q("stream_log_dedup")
def stream_log_dedup(spark, d):
    out = S.run_available(S.log_dedup(_log_stream(spark, d)), "log_dedup")
    return out.select("prediction_id", "seq", "timestamp", "prediction", F.round("probability", 6).alias("probability"),
                      "latency_ms", F.col("features")["k"].try_cast("double").alias("feat_k"),
                      F.col("features")["value"].try_cast("double").alias("feat_value"))


SQL["stream_log_dedup"] = f"""WITH {LOG_SQL}
SELECT prediction_id, seq, "timestamp", prediction, round(probability, 6) AS probability, latency_ms, feat_k, feat_value
FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY seq) AS rn FROM log) WHERE rn = 1"""


@q("stream_throughput")
def stream_throughput(spark, d):
    return S.run_available(S.throughput(_log_stream(spark, d)), "throughput")


SQL["stream_throughput"] = f"""SELECT * FROM (
  SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS requests
  FROM events GROUP BY 1, 2) WHERE {CLOSED}"""


@q("stream_throughput_sliding")
def stream_throughput_sliding(spark, d):
    return S.run_available(S.throughput(_log_stream(spark, d), "1 day", "6 hours"), "throughput_sliding")


SQL["stream_throughput_sliding"] = f"""SELECT * FROM (
  SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, count(*) AS requests
  FROM (SELECT ts, time_bucket(INTERVAL 6 HOURS, ts) - i * INTERVAL 6 HOURS AS w FROM events, range(4) r(i))
  GROUP BY 1, 2) WHERE {CLOSED}"""


@q("stream_error_rate")
def stream_error_rate(spark, d):
    return S.run_available(S.error_rate(_log_stream(spark, d)), "error_rate")


SQL["stream_error_rate"] = f"""WITH {LOG_SQL} SELECT * FROM (
  SELECT date_trunc('day', "timestamp") AS window_start, date_trunc('day', "timestamp") + INTERVAL 1 DAY AS window_end, count(*) AS total,
    count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS errors_4xx, count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) AS errors_5xx,
    round(count(*) FILTER (WHERE status_code BETWEEN 400 AND 599) / count(*), 4) AS error_rate
  FROM log GROUP BY 1, 2) WHERE {CLOSED}"""


@q("stream_latency")
def stream_latency(spark, d):
    return S.run_available(S.latency(_log_stream(spark, d)), "latency")


def _rank_value(lst: str, p: float) -> str:
    """Value a percentile sketch returns when its rank error is below one row:
    the smallest value with at least p * n values <= it."""
    return f"{lst}[greatest(1, CAST(ceil(len({lst}) * CAST({p} AS DOUBLE)) AS BIGINT))]"


SQL["stream_latency"] = f"""SELECT * FROM (
  SELECT window_start, window_end, count,
    round({_rank_value("v", 0.5)}, 2) AS p50_ms, round({_rank_value("v", 0.95)}, 2) AS p95_ms,
    round({_rank_value("v", 0.99)}, 2) AS p99_ms
  FROM (SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
          count(*) AS count, list(value ORDER BY value) AS v
        FROM events WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE {CLOSED}"""


@q("stream_missing")
def stream_missing(spark, d):
    return S.run_available(S.missing(_log_stream(spark, d)), "missing")


SQL["stream_missing"] = f"""WITH kv AS (
  SELECT ts, 'k' AS feature, json_extract_string(props, '$.k') AS v FROM events
  UNION ALL SELECT ts, 'value', CASE WHEN event_type <> 'view' THEN CAST(value AS VARCHAR) END FROM events)
SELECT * FROM (
  SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, feature,
    count(*) AS total, count(*) FILTER (WHERE v IS NULL OR isnan(TRY_CAST(v AS DOUBLE))) AS missing,
    round(count(*) FILTER (WHERE v IS NULL OR isnan(TRY_CAST(v AS DOUBLE))) / count(*), 4) AS missing_rate
  FROM kv GROUP BY 1, 2, 3) WHERE {CLOSED}"""


@q("stream_feedback_join")
def stream_feedback_join(spark, d):
    log = _log_stream(spark, d)
    fb = feedback_from_events(S.table_stream(spark, d, "events"))
    return S.latest_outcomes(S.run_available(S.feedback_join(log, fb), "feedback_join"))


SQL["stream_feedback_join"] = f"""WITH {LOG_SQL}, {FEEDBACK_SQL},
wm AS (SELECT least((SELECT max(ts) FROM events), (SELECT max(ts) FROM events WHERE event_type = 'purchase'))
              - INTERVAL 1 HOUR AS w),
m AS (SELECT l.prediction_id, l."timestamp", l.prediction, f.outcome AS actual_outcome, f.feedback_timestamp, f.fb_seq
      FROM log l JOIN fb_raw f ON l.prediction_id = f.prediction_id
        AND f.feedback_timestamp >= l."timestamp" AND f.feedback_timestamp <= l."timestamp" + INTERVAL 30 DAY),
u AS (SELECT l.prediction_id, l."timestamp", l.prediction, CAST(NULL AS INTEGER) AS actual_outcome,
             CAST(NULL AS TIMESTAMP) AS feedback_timestamp
      FROM log l WHERE l."timestamp" + INTERVAL 30 DAY < (SELECT w FROM wm)
        AND NOT EXISTS (SELECT 1 FROM m WHERE m.prediction_id = l.prediction_id AND m."timestamp" = l."timestamp"))
SELECT prediction_id, "timestamp", prediction, actual_outcome, feedback_timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY feedback_timestamp DESC, fb_seq DESC) AS rn FROM m) WHERE rn = 1
UNION ALL SELECT * FROM u"""


@q("stream_feedback_final")
def stream_feedback_final(spark, d):
    """T5 with keyed state: one row per prediction when its deadline has passed, the last call wins in the stream."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, FB.ROCKSDB)
    try:
        calls = feedback_from_events(S.table_stream(spark, d, "events"))
        return S.run_available(FB.final_outcomes(_log_stream(spark, d), calls, max_delay_days=10), "feedback_final")
    finally:
        spark.conf.set(name, before)


SQL["stream_feedback_final"] = f"""WITH {LOG_SQL}, {FEEDBACK_SQL},
l AS (SELECT prediction_id, "timestamp", prediction FROM log WHERE "timestamp" + INTERVAL 10 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
m AS (SELECT l.prediction_id, f.outcome, f.feedback_timestamp, row_number() OVER (PARTITION BY l.prediction_id ORDER BY f.feedback_timestamp DESC, f.fb_seq DESC) AS rn
  FROM l JOIN fb_raw f ON l.prediction_id = f.prediction_id AND f.feedback_timestamp BETWEEN l."timestamp" AND l."timestamp" + INTERVAL 10 DAY)
SELECT l.prediction_id, l."timestamp", l.prediction, m.outcome AS actual_outcome, m.feedback_timestamp FROM l LEFT JOIN m ON m.prediction_id = l.prediction_id AND m.rn = 1"""


@q("stream_concept")
def stream_concept(spark, d):
    lab = S.table_stream(spark, d, "labels").withColumn("model", F.lit("quality_model"))
    return S.concept_windows(lab, "model", "doc_id", "toxic", "quality")


def _stream_concept_sql():
    """Complete windows only (the open window stays in state); baseline = mean F1
    of all earlier windows, the window's own F1 for the first."""
    from featurewatch.plans.q_classify import _WINDOWS
    return f"""WITH {_WINDOWS},
b AS (SELECT *, avg(f1) OVER (ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base0
      FROM w WHERE n = 20),
c AS (SELECT *, coalesce(base0, f1) AS base FROM b)
SELECT 'quality_model' AS model, window_index, n, tp, fp, fn, tn, f1, precision, recall, accuracy,
  round(base, 4) AS baseline_f1,
  CASE WHEN f1 - base > -0.05 THEN 'OK' WHEN f1 - base > -0.10 THEN 'WARNING' ELSE 'DRIFT_DETECTED' END AS status,
  start_time AS start_seq, end_time AS end_seq
FROM c"""


SQL["stream_concept"] = _stream_concept_sql()


@q("stream_drift")
def stream_drift(spark, d):
    from featurewatch.functions.nulls import nan_to_null
    ref = drift_long(spark, d).filter(F.col("side") == REF)

    def to_long(batch):
        prod = batch.filter(F.col("l_returnflag") == "R")
        wide = prod.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in DRIFT_FEATURES])
        return wide.unpivot([], DRIFT_FEATURES, "feature", "value").select(
            "feature", F.lit(PROD).alias("side"), "value")

    return S.drift_per_batch(S.table_stream(spark, d, "lineitem"), ref, to_long)


def _stream_drift_sql():
    """One input file = one micro-batch (id 0): its report equals the batch drift report."""
    from featurewatch.plans.q_drift import SQL as DSQL
    return "SELECT *, 0 AS batch_id FROM (" + DSQL["drift_report"] + ")"


SQL["stream_drift"] = _stream_drift_sql()


@q("stream_materialize")
def stream_materialize(spark, d):
    from featurewatch.plans.q_store import ORDERS_VALUE
    rows = FS.ingest_view(S.table_stream(spark, d, "orders"), ORDERS_VALUE, "o_custkey", "o_orderdate")
    return S.materialize_stream(rows, "cust_id", FS.EVENT_TS, ["o_totalprice", "o_orderkey"], tiebreak="o_orderkey")


SQL["stream_materialize"] = """WITH fv AS (SELECT CAST(o_custkey AS VARCHAR) AS cust_id, o_orderdate AS event_timestamp,
  o_totalprice, o_orderkey FROM orders)
SELECT cust_id, event_timestamp, o_totalprice, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY event_timestamp DESC, o_orderkey DESC) AS rn FROM fv)
WHERE rn = 1"""
