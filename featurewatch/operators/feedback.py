"""Feedback on logged predictions.

The reference mutates log rows in place; here feedback is its own append-only
table and the log view is a join.  A later call for the same id wins: the
latest call per id is picked with ``max_by`` (a map-side combinable
aggregate, so an id hammered by many calls costs one row per task), after
which the join is one-to-one on ``prediction_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_feedback(feedback: DataFrame, id_col: str = "prediction_id", outcome_col: str = "outcome",
                    ts_col: str = "feedback_timestamp", seq_col: str = "fb_seq") -> DataFrame:
    """One row per id: the outcome of the newest call (by time, then call order)."""
    order = F.struct(F.col(ts_col), F.col(seq_col))
    latest = F.max_by(F.struct(F.col(outcome_col).alias("o"), F.col(ts_col).alias("t")), order)
    return (feedback.groupBy(id_col).agg(latest.alias("__l"))
            .select(id_col, F.col("__l.o").cast("int").alias("actual_outcome"),
                    F.col("__l.t").alias("feedback_timestamp")))


def feedback_join(log: DataFrame, feedback: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Log rows with the latest confirmed outcome (NULL when none)."""
    base = log.drop("actual_outcome", "feedback_timestamp")
    return base.join(latest_feedback(feedback, id_col), id_col, "left")


def feedback_orphans(feedback: DataFrame, log: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Feedback calls for ids the log does not know (the reference's False / 404)."""
    return feedback.join(log.select(id_col), id_col, "left_anti")


def feedback_pending(log: DataFrame, feedback: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Predictions still awaiting an outcome."""
    return log.join(feedback.select(id_col), id_col, "left_anti")


def confirmed_only(joined_log: DataFrame) -> DataFrame:
    """Rows with a confirmed outcome."""
    return joined_log.filter(F.col("actual_outcome").isNotNull())
