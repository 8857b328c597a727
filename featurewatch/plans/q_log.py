"""Prediction-log queries (S9, S10, A1-A6, W4, W5, J4-J6, P8) on ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurewatch.operators import feedback as FB
from featurewatch.operators import log_stats as LS
from featurewatch.plans.roles import np_percentile_sql, sround, FB_LATEST_SQL, FEEDBACK_SQL, LOG_SQL, feedback_raw, prediction_log
from featurewatch.sources.tables import load

Q, SQL = {}, {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


W = f"WITH {LOG_SQL}"
WF = f"WITH {LOG_SQL}, {FEEDBACK_SQL}, {FB_LATEST_SQL}"


def _flat(log):
    return log.select("prediction_id", "seq", "timestamp", "prediction",
                      F.round("probability", 6).alias("probability"), "latency_ms",
                      F.col("features")["k"].try_cast("double").alias("feat_k"),
                      F.col("features")["value"].try_cast("double").alias("feat_value"),
                      "actual_outcome", "feedback_timestamp")


_FLAT_SQL = """prediction_id, seq, "timestamp", prediction, round(probability, 6) AS probability, latency_ms,
  feat_k, feat_value"""


@q("prediction_log_build")
def prediction_log_build(spark, d):
    return _flat(prediction_log(spark, d))


SQL["prediction_log_build"] = W + f"""
SELECT {_FLAT_SQL}, CAST(NULL AS INTEGER) AS actual_outcome, CAST(NULL AS TIMESTAMP) AS feedback_timestamp FROM log"""


@q("prediction_log_append")
def prediction_log_append(spark, d):
    """Two batches appended to the stored log, read back."""
    log, name = prediction_log(spark, d), uuid.uuid4().hex
    for part in (0, 1):
        LS.append_log(spark, log.filter(F.col("seq") % 2 == part), name)
    return _flat(LS.read_log(spark, name))


SQL["prediction_log_append"] = SQL["prediction_log_build"]


@q("prediction_stats")
def prediction_stats(spark, d):
    return LS.prediction_stats(prediction_log(spark, d))


SQL["prediction_stats"] = W + """
SELECT count(*) AS total_predictions, round(coalesce(avg(prediction), 0), 6) AS risk_rate,
  round(coalesce(avg(probability), 0), 6) AS avg_probability, round(coalesce(min(probability), 0), 6) AS min_probability,
  round(coalesce(max(probability), 0), 6) AS max_probability, round(coalesce(stddev_pop(probability), 0), 6) AS std_probability,
  arg_max("timestamp", seq) AS last_prediction_time
FROM log"""


@q("latency_percentiles")
def latency_percentiles(spark, d):
    return LS.latency_percentiles(prediction_log(spark, d))


SQL["latency_percentiles"] = W + f"""
SELECT count, round(coalesce(avg_ms, 0), 2) AS avg_ms, round(coalesce(min_ms, 0), 2) AS min_ms,
  round(coalesce(max_ms, 0), 2) AS max_ms,
  coalesce({sround(np_percentile_sql("v", 0.5), 2)}, 0.0) AS p50_ms,
  coalesce({sround(np_percentile_sql("v", 0.95), 2)}, 0.0) AS p95_ms,
  coalesce({sround(np_percentile_sql("v", 0.99), 2)}, 0.0) AS p99_ms
FROM (SELECT count(latency_ms) AS count, avg(latency_ms) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
        list(latency_ms ORDER BY latency_ms) AS v FROM log WHERE latency_ms IS NOT NULL)"""


@q("latency_percentiles_approx")
def latency_percentiles_approx(spark, d):
    return LS.latency_percentiles_approx(prediction_log(spark, d), accuracy=1_000_000)


# with a rank error below one row the sketch returns the value at rank ceil(p n)
SQL["latency_percentiles_approx"] = """WITH v AS (SELECT list(value ORDER BY value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL)
SELECT n AS count, round(v[greatest(1, CAST(ceil(n * 0.5) AS BIGINT))], 2) AS p50_ms, round(v[greatest(1, CAST(ceil(n * 0.95) AS BIGINT))], 2) AS p95_ms,
  round(v[greatest(1, CAST(ceil(n * 0.99) AS BIGINT))], 2) AS p99_ms FROM v"""


@q("missing_rates")
def missing_rates(spark, d):
    return LS.missing_rates(prediction_log(spark, d))


SQL["missing_rates"] = """WITH kv AS (
  SELECT 'k' AS feature, json_extract_string(props, '$.k') AS v FROM events
  UNION ALL SELECT 'value' AS feature, CASE WHEN event_type <> 'view' THEN CAST(value AS VARCHAR) END AS v FROM events),
a AS (SELECT feature, count(*) AS total,
        count(*) FILTER (WHERE v IS NULL OR isnan(TRY_CAST(v AS DOUBLE))) AS missing FROM kv GROUP BY feature)
SELECT feature, total, missing, round(CAST(missing AS DOUBLE) / total, 4) AS missing_rate,
  CASE WHEN round(CAST(missing AS DOUBLE) / total, 4) > 0.2 THEN 'red'
       WHEN round(CAST(missing AS DOUBLE) / total, 4) > 0.05 THEN 'amber' ELSE 'ok' END AS severity
FROM a"""


@q("throughput")
def throughput(spark, d):
    return LS.throughput(prediction_log(spark, d), 60)


SQL["throughput"] = W + """
SELECT 60 AS window_minutes, count(*) FILTER (WHERE "timestamp" >= (SELECT max("timestamp") FROM log) - INTERVAL 60 MINUTE)
  AS requests_in_window,
  round(CAST(count(*) FILTER (WHERE "timestamp" >= (SELECT max("timestamp") FROM log) - INTERVAL 60 MINUTE) AS DOUBLE) / 60, 2)
  AS avg_per_minute
FROM log"""


@q("throughput_series")
def throughput_series(spark, d):
    return LS.throughput_series(prediction_log(spark, d), 60)


SQL["throughput_series"] = W + """
SELECT date_trunc('hour', "timestamp") AS window_start, date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end,
  count(*) AS requests, round(CAST(count(*) AS DOUBLE) / 60, 2) AS avg_per_minute
FROM log GROUP BY 1, 2"""


@q("error_rate")
def error_rate(spark, d):
    return LS.error_rate(prediction_log(spark, d))


SQL["error_rate"] = W + """
SELECT count(*) AS total, count(*) FILTER (WHERE status_code >= 400 AND status_code < 500) AS errors_4xx,
  count(*) FILTER (WHERE status_code >= 500 AND status_code < 600) AS errors_5xx,
  CAST(round(coalesce(CAST(count(*) FILTER (WHERE status_code >= 400 AND status_code < 600) AS DOUBLE) / nullif(count(*), 0), 0), 4) AS DOUBLE) AS error_rate
FROM log"""


@q("batch_summary")
def batch_summary(spark, d):
    log = prediction_log(spark, d).withColumn("batch_id", F.floor(F.col("seq") / 100))
    return LS.batch_summary(log, "batch_id")


SQL["batch_summary"] = W + """
SELECT CAST(floor(seq / 100) AS BIGINT) AS batch_id, count(*) AS total,
  count(*) FILTER (WHERE prediction = 1) AS at_risk, count(*) FILTER (WHERE prediction = 0) AS not_at_risk,
  round(CAST(count(*) FILTER (WHERE prediction = 1) AS DOUBLE) / count(*), 4) AS risk_rate
FROM log GROUP BY 1"""


@q("log_retention")
def log_retention(spark, d):
    return _flat(LS.log_retention(prediction_log(spark, d), max_rows=5000))


SQL["log_retention"] = W + f"""
SELECT {_FLAT_SQL}, CAST(NULL AS INTEGER) AS actual_outcome, CAST(NULL AS TIMESTAMP) AS feedback_timestamp
FROM log ORDER BY seq DESC LIMIT 5000"""


def _joined(spark, d):
    return FB.feedback_join(prediction_log(spark, d), feedback_raw(spark, d))


@q("feedback_join")
def feedback_join(spark, d):
    return _flat(_joined(spark, d))


SQL["feedback_join"] = WF + f"""
SELECT {_FLAT_SQL}, CAST(fb.actual_outcome AS INTEGER) AS actual_outcome, fb.feedback_timestamp
FROM log LEFT JOIN fb USING (prediction_id)"""


@q("confirmed_only")
def confirmed_only(spark, d):
    return _flat(FB.confirmed_only(_joined(spark, d)))


SQL["confirmed_only"] = WF + f"""
SELECT {_FLAT_SQL}, CAST(fb.actual_outcome AS INTEGER) AS actual_outcome, fb.feedback_timestamp
FROM log JOIN fb USING (prediction_id) WHERE fb.actual_outcome IS NOT NULL"""


@q("feedback_orphans")
def feedback_orphans(spark, d):
    return FB.feedback_orphans(feedback_raw(spark, d), prediction_log(spark, d))


SQL["feedback_orphans"] = WF + """
SELECT prediction_id, outcome, feedback_timestamp, fb_seq FROM fb_raw
WHERE prediction_id IS NULL OR prediction_id NOT IN (SELECT prediction_id FROM log)"""


@q("feedback_pending")
def feedback_pending(spark, d):
    return _flat(FB.feedback_pending(prediction_log(spark, d), feedback_raw(spark, d)))


SQL["feedback_pending"] = WF + f"""
SELECT {_FLAT_SQL}, CAST(NULL AS INTEGER) AS actual_outcome, CAST(NULL AS TIMESTAMP) AS feedback_timestamp
FROM log WHERE NOT EXISTS (SELECT 1 FROM fb_raw WHERE fb_raw.prediction_id = log.prediction_id)"""


@q("recent_predictions")
def recent_predictions(spark, d):
    return LS.recent_predictions(prediction_log(spark, d), limit=20, feedback=feedback_raw(spark, d))


SQL["recent_predictions"] = WF + """
SELECT prediction_id, seq, "timestamp", prediction, round(probability, 4) AS probability,
  CASE WHEN probability IS NULL THEN '—' WHEN probability >= 0.8 THEN 'Muito Alto' WHEN probability >= 0.6 THEN 'Alto'
       WHEN probability >= 0.4 THEN 'Moderado' WHEN probability >= 0.2 THEN 'Baixo' ELSE 'Muito Baixo' END AS risk_level,
  CAST(fb.actual_outcome AS INTEGER) AS actual_outcome, fb.feedback_timestamp
FROM log LEFT JOIN fb USING (prediction_id) ORDER BY seq DESC LIMIT 20"""


REQUEST_ITEM = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@q("json_requests_explode")
def json_requests_explode(spark, d):
    """Batch request bodies (JSON arrays of at most 100 items, one per
    block of 100 event ids) parsed back into rows.  Each group is bounded by
    the batch size, so no task holds an unbounded list."""
    from featurewatch.sources.requests import explode_json_requests
    ev = load(spark, d, "events")
    bodies = (ev.groupBy(F.floor(F.col("event_id") / 100).alias("batch_id"))
              .agg(F.to_json(F.collect_list(F.struct("event_id", "user_id", "value", "props"))).alias("body")))
    return explode_json_requests(bodies, "body", REQUEST_ITEM, keep=["batch_id"])


SQL["json_requests_explode"] = """
SELECT CAST(floor(event_id / 100) AS BIGINT) AS batch_id, event_id, user_id, value, props FROM events"""
