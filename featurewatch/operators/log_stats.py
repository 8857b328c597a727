"""Prediction log and its operational statistics.

The log is an append-only table, one row per prediction::

    prediction_id STRING, seq LONG, timestamp TIMESTAMP, features MAP<STRING,STRING>,
    prediction INT, probability DOUBLE, latency_ms DOUBLE,
    actual_outcome INT, feedback_timestamp TIMESTAMP

``seq`` is the logging order (the reference's list position).  Feedback is a
separate table joined in (operators/feedback.py) instead of mutating rows.
Every statistic here is a single aggregate (partial + final) or a running
count by ranges — no operator collects the log into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurewatch.functions.derive import risk_band
from featurewatch.operators.feedback import feedback_join
from featurewatch.operators.ordering import BUCKETS, running_sums
from featurewatch.session import storage_path


def build_log(df: DataFrame, id_col: Column, seq_col: Column, ts_col: Column, prediction: Column,
              probability: Column, latency_ms: Column | None = None, features: Column | None = None,
              extra: dict[str, Column] | None = None) -> DataFrame:
    """Shape scored rows as log rows (outcome and feedback time still NULL)."""
    cols = [
        id_col.alias("prediction_id"), seq_col.cast("long").alias("seq"), ts_col.alias("timestamp"),
        (features if features is not None else F.create_map().cast("map<string,string>")).alias("features"),
        prediction.cast("int").alias("prediction"), probability.cast("double").alias("probability"),
        (latency_ms if latency_ms is not None else F.lit(None)).cast("double").alias("latency_ms"),
        F.lit(None).cast("int").alias("actual_outcome"),
        F.lit(None).cast("timestamp_ntz").alias("feedback_timestamp"),
    ]
    for name, e in (extra or {}).items():
        cols.append(e.alias(name))
    return df.select(*cols)


#: Parts of one day's rows in an append.
DAY_PARTS = 16


def append_log(spark: SparkSession, rows: DataFrame, name: str = "predictions") -> str:
    """Appends log rows to the shared log table, one folder per day (P9 reads only the days that it needs).
    A day's rows are dealt by a hash over ``DAY_PARTS`` parts, so a busy day is written by several tasks."""
    path = storage_path(spark, "log", name)
    rows.withColumn("log_date", F.to_date("timestamp")).repartition(
        "log_date", F.pmod(F.xxhash64("prediction_id", "seq", "timestamp"), F.lit(DAY_PARTS))).write.mode("append").partitionBy("log_date").parquet(path)
    return path


def read_log(spark: SparkSession, name: str = "predictions") -> DataFrame:
    return spark.read.parquet(storage_path(spark, "log", name)).drop("log_date")


def prediction_stats(log: DataFrame) -> DataFrame:
    """A1: total, risk rate, probability mean/min/max/population std, time of
    the last LOGGED row (max seq, not max time).  Empty log -> zeros."""
    a = log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("prediction").alias("risk_rate"),
        F.avg("probability").alias("avg_probability"),
        F.min("probability").alias("min_probability"),
        F.max("probability").alias("max_probability"),
        F.stddev_pop("probability").alias("std_probability"),
        F.max_by("timestamp", "seq").alias("last_prediction_time"))
    z = F.lit(0.0)
    return a.select(
        "total_predictions",
        F.round(F.coalesce("risk_rate", z), 6).alias("risk_rate"),
        F.round(F.coalesce("avg_probability", z), 6).alias("avg_probability"),
        F.round(F.coalesce("min_probability", z), 6).alias("min_probability"),
        F.round(F.coalesce("max_probability", z), 6).alias("max_probability"),
        F.round(F.coalesce("std_probability", z), 6).alias("std_probability"),
        "last_prediction_time")


def exact_percentiles(df: DataFrame, value_col: str, probs: Sequence[float], groups: Sequence[str] = (),
                      buckets: int | None = BUCKETS, count_col: str | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (numpy / Spark ``percentile``)
    without holding all values in one task: values are reduced to
    ``value -> count``, ranked with running counts by ranges, and the two
    order statistics around each position ``(n-1)p`` are selected by a
    filtered aggregate.  One row with ``p_<i>`` columns, per group if given.
    With ``count_col`` a row stands for so many equal ones."""
    count = F.sum(count_col) if count_col else F.count(F.lit(1))
    red = df.filter(F.col(value_col).isNotNull()).groupBy(*groups, value_col).agg(count.alias("cnt"))
    j = running_sums(red, groups, [value_col], {"cum": F.col("cnt")}, buckets=buckets, facts={"n": ("sum", F.col("cnt"))})
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo_rank = F.floor(pos)
        hi_rank = F.ceil(pos)
        # value at 0-based rank r: the smallest value whose cumulative count exceeds r
        aggs.append(F.min(F.when(F.col("cum") > lo_rank, F.col(value_col))).alias(f"lo_{i}"))
        aggs.append(F.min(F.when(F.col("cum") > hi_rank, F.col(value_col))).alias(f"hi_{i}"))
        aggs.append(F.first(pos - lo_rank).alias(f"fr_{i}"))
    sel = j.groupBy(*groups).agg(*aggs)
    return sel.select(*groups, *[numpy_lerp(F.col(f"lo_{i}"), F.col(f"hi_{i}"), F.col(f"fr_{i}")).alias(f"p_{i}")
                                 for i in range(len(probs))])


def numpy_lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation between neighbours a <= b at fraction t
    (it switches to the upper form for t >= 0.5 to stay monotone)."""
    return F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)


def latency_percentiles(log: DataFrame, buckets: int | None = BUCKETS) -> DataFrame:
    """A2: count/avg/min/max/p50/p95/p99 of non-null latencies, rounded to 2; empty -> zeros."""
    lat = log.select(F.col("latency_ms").alias("v")).filter(F.col("v").isNotNull())
    basic = lat.agg(F.count(F.lit(1)).alias("count"), F.avg("v").alias("avg"),
                    F.min("v").alias("min"), F.max("v").alias("max"))
    pct = exact_percentiles(lat, "v", [0.5, 0.95, 0.99], buckets=buckets).select(F.struct("*").alias("s")).scalar()
    z = F.lit(0.0)
    return basic.select(
        "count",
        *[F.round(F.coalesce(F.col(c), z), 2).alias(f"{c}_ms") for c in ("avg", "min", "max")],
        F.round(F.coalesce(pct["p_0"], z), 2).alias("p50_ms"),
        F.round(F.coalesce(pct["p_1"], z), 2).alias("p95_ms"),
        F.round(F.coalesce(pct["p_2"], z), 2).alias("p99_ms"))


def latency_percentiles_approx(log: DataFrame, accuracy: int = 10000) -> DataFrame:
    """A2 at scale: ``percentile_approx`` (one sketch per task, merged)."""
    lat = log.filter(F.col("latency_ms").isNotNull())
    q = F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy)
    return lat.agg(F.count(F.lit(1)).alias("count"), q.alias("q")).select(
        "count", F.round(F.col("q")[0], 2).alias("p50_ms"), F.round(F.col("q")[1], 2).alias("p95_ms"),
        F.round(F.col("q")[2], 2).alias("p99_ms"))


def missing_rates(log: DataFrame, red: float = 0.20, amber: float = 0.05) -> DataFrame:
    """A3 + O5: per feature of the logged map: total, missing (NULL or NaN),
    rate rounded 4 and a dashboard severity, highest rate first."""
    kv = log.select(F.explode("features").alias("feature", "v"))
    miss = F.col("v").isNull() | F.isnan(F.col("v").try_cast("double"))
    agg = kv.groupBy("feature").agg(F.count(F.lit(1)).alias("total"),
                                   F.count_if(miss).alias("missing"))
    rate = F.round(F.col("missing") / F.col("total"), 4)
    return agg.select("feature", "total", "missing", rate.alias("missing_rate"),
                      F.when(rate > red, "red").when(rate > amber, "amber").otherwise("ok").alias("severity")
                      ).orderBy(F.col("missing_rate").desc(), "feature")


def throughput(log: DataFrame, window_minutes: int = 60, as_of: str | None = None) -> DataFrame:
    """A4 with P9: rows with ``timestamp >= as_of - window``; ``as_of`` defaults to
    the newest logged time so results are repeatable (not wall clock)."""
    ref = log.agg(F.max("timestamp")).scalar() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    cutoff = ref - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(window_minutes))
    n = log.filter(F.col("timestamp") >= cutoff).agg(F.count(F.lit(1)).alias("requests_in_window"))
    per_min = (F.round(F.col("requests_in_window") / F.lit(window_minutes), 2) if window_minutes > 0
               else F.lit(0.0))
    return n.select(F.lit(window_minutes).alias("window_minutes"), "requests_in_window",
                    per_min.cast("double").alias("avg_per_minute"))


def throughput_series(log: DataFrame, window_minutes: int = 60, slide_minutes: int | None = None) -> DataFrame:
    """A4 as a series: tumbling (or sliding) windows over the log time."""
    dur = f"{window_minutes} minutes"
    w = F.window("timestamp", dur, f"{slide_minutes} minutes") if slide_minutes else F.window("timestamp", dur)
    return (log.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests",
                    F.round(F.col("requests") / F.lit(window_minutes), 2).alias("avg_per_minute")))


def error_rate(requests: DataFrame, status_col: str = "status_code") -> DataFrame:
    """A5: total, 4xx, 5xx, (4xx + 5xx) / total rounded 4 (0 when empty)."""
    s = F.col(status_col)
    a = requests.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if((s >= 400) & (s < 500)).alias("errors_4xx"),
                     F.count_if((s >= 500) & (s < 600)).alias("errors_5xx"))
    return a.select("total", "errors_4xx", "errors_5xx", F.round(F.coalesce(
        F.try_divide(F.col("errors_4xx") + F.col("errors_5xx"), F.col("total")), F.lit(0.0)), 4)
        .cast("double").alias("error_rate"))


def batch_summary(scored: DataFrame, batch_col: str, prediction_col: str = "prediction") -> DataFrame:
    """Per batch total, at risk, not at risk, risk rate (0 if empty)."""
    p = F.col(prediction_col)
    a = scored.groupBy(batch_col).agg(F.count(F.lit(1)).alias("total"),
                                      F.count_if(p == 1).alias("at_risk"),
                                      F.count_if(p == 0).alias("not_at_risk"))
    return a.select(batch_col, "total", "at_risk", "not_at_risk",
                    F.round(F.coalesce(F.try_divide(F.col("at_risk"), F.col("total")), F.lit(0.0)), 4)
                    .cast("double").alias("risk_rate"))


def log_retention(log: DataFrame, max_rows: int = 10000) -> DataFrame:
    """Keep the newest ``max_rows`` rows by logging order (``seq`` is unique).  The cut is the smallest of the
    newest numbers, found by a top-k over that one column; the rows are then a plain filter."""
    newest = log.select("seq").orderBy(F.col("seq").desc()).limit(max_rows)
    return log.filter(F.col("seq") >= newest.agg(F.min("seq")).scalar())


def recent_predictions(log: DataFrame, limit: int = 20, feedback: DataFrame | None = None) -> DataFrame:
    """Newest ``limit`` rows, newest first, rounded probability, band (or
    '—' without probability) and feedback fields.  A top-k report: TakeOrdered
    over the log alone; ``feedback`` calls are then joined to those rows only."""
    top = log.orderBy(F.col("seq").desc()).limit(limit)
    if feedback is not None:
        calls = feedback.join(F.broadcast(top.select("prediction_id")), "prediction_id", "left_semi")  # at most ``limit`` ids
        top = feedback_join(top, calls)
    return top.select(
        "prediction_id", "seq", "timestamp", "prediction",
        F.round("probability", 4).alias("probability"),
        F.coalesce(risk_band(F.col("probability")), F.lit("—")).alias("risk_level"),
        "actual_outcome", "feedback_timestamp")
