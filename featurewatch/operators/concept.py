"""Concept drift over positional windows of confirmed predictions.

Windows are consecutive blocks of ``window_size`` confirmed rows in logging
order.  The position of each row is a row number by ranges (no
single-task window), after which every window is an ordinary ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurewatch.operators.ordering import BUCKETS, global_row_number

# Fixed values from the reference's concept-drift rules.
WINDOW_SIZE = 20
MIN_WINDOW_ROWS = 5
F1_DELTA_OK = -0.05
F1_DELTA_WARNING = -0.10


def concept_windows(confirmed: DataFrame, order_col: str, y: str, yhat: str,
                    window_size: int = WINDOW_SIZE, min_rows: int = MIN_WINDOW_ROWS,
                    ts_col: str | None = None, groups: list[str] | None = None,
                    buckets: int | None = BUCKETS) -> DataFrame:
    """W1 + W2: per window counts, precision, recall, F1, accuracy (rounded 4),
    first and last order value (and time); windows under ``min_rows`` dropped."""
    groups = groups or []
    rn = global_row_number(confirmed, [order_col], groups=groups, name="__rn", buckets=buckets)
    t, p = F.col(y), F.col(yhat)
    ts = F.col(ts_col) if ts_col else F.col(order_col)
    g = (rn.withColumn("window_index", F.floor((F.col("__rn") - 1) / window_size).cast("long"))
         .groupBy(*groups, "window_index")
         .agg(F.count(F.lit(1)).alias("n"),
              F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
              F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 0)).alias("tn"),
              F.min_by(ts, F.col("__rn")).alias("start"), F.max_by(ts, F.col("__rn")).alias("end"))
         .filter(F.col("n") >= min_rows))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    # Only the last window can be short, so kept windows keep their positional label.
    return g.select(*groups, F.concat(F.lit("W"), (F.col("window_index") + 1).cast("string")).alias("label"),
                    "window_index", "n", "tp", "fp", "fn", "tn",
                    F.round(f1, 4).alias("f1"), F.round(rec, 4).alias("recall"),
                    F.round(prec, 4).alias("precision"),
                    F.round((F.col("tp") + F.col("tn")) / F.col("n"), 4).alias("accuracy"),
                    F.col("start").alias("start_time"), F.col("end").alias("end_time"))


def concept_verdict(windows: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Latest window F1 vs the mean of the (rounded) F1 of all earlier
    windows (itself when alone); OK / WARNING / DRIFT_DETECTED with alert text.
    The window table is tiny (rows / window_size), so ordinary windows are fine."""
    a = windows.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.max_by("f1", "window_index").alias("latest_f1"),
        F.max("window_index").alias("__last"),
        F.sum("f1").alias("__sum"))
    baseline = F.when(F.col("n_windows") >= 2,
                      (F.col("__sum") - F.col("latest_f1")) / (F.col("n_windows") - 1)).otherwise(F.col("latest_f1"))
    n_conf = (confirmed.agg(F.count(F.lit(1))).scalar() if confirmed is not None
              else F.col("n_windows"))
    d = a.select("n_windows", n_conf.alias("confirmed_count"), "latest_f1", baseline.alias("baseline_f1"))
    delta = F.col("latest_f1") - F.col("baseline_f1")
    pct = F.format_string("%.1f", F.abs(delta) * 100)
    status = (F.when(F.col("n_windows") == 0,
                     F.when(F.col("confirmed_count") == 0, "NO_DATA").otherwise("INSUFFICIENT_DATA"))
              .when(delta > F1_DELTA_OK, "OK").when(delta > F1_DELTA_WARNING, "WARNING")
              .otherwise("DRIFT_DETECTED"))
    alert = (F.when(delta > F1_DELTA_OK, F.lit(None).cast("string"))
             .when(delta > F1_DELTA_WARNING,
                   F.concat(F.lit("WARNING: F1 fell by "), pct, F.lit(" points")))
             .otherwise(F.concat(F.lit("DRIFT_DETECTED: F1 fell by "), pct, F.lit(" points"))))
    return d.select(status.alias("status"), "confirmed_count", "n_windows",
                    F.round("latest_f1", 4).alias("latest_f1"), F.round("baseline_f1", 4).alias("baseline_f1"),
                    F.round(delta, 4).alias("f1_delta"), alert.alias("alert_message"))
