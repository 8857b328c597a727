"""Drift over the last N days of a log.

Production values are kept as reduced tables per day, ``(day, feature, value)
-> n``, in a folder per batch and month; such tables can be added and
subtracted.  A window of N days is kept the same way: when it moves, only the
months of the days that enter or leave it, and the batches that came since, are
read, and these days are added to or taken from the counts of the window.  The report then is the batch report of these counts, so
it equals a report over the raw rows of these days, late rows included.

Everything lies under one folder, and every batch writes folders of its own
(``days/batch=<id>/month=<month>``, ``window/v=<id>``), so a replayed batch
overwrites what it wrote before and reads the version before its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurewatch.operators.drift import MIN_PRODUCTION_VALUES, REF, reduce_values, report_from_reduced

_DAYS = "day date, feature string, value double, n long, batch long, month string"
_WINDOW = "feature string, value double, n long"
_META = "as_of date, n_days int"


def _window_days(as_of: dt.date | None, n_days: int) -> set[dt.date]:
    return {as_of - dt.timedelta(days=i) for i in range(n_days)} if as_of else set()


def _months(days: set[dt.date]) -> list[str]:
    return sorted({d.strftime("%Y-%m") for d in days})


class DayWindow:
    """The last ``n_days`` days of production values, stored under ``root``; batches are numbered 0, 1, 2, ..."""

    def __init__(self, spark: SparkSession, root: str, n_days: int):
        self.spark, self.root, self.n_days = spark, root, n_days

    def add(self, rows: DataFrame, batch: int) -> None:
        """Stores the rows (``day``, ``feature``, ``value``) of a batch, reduced; rows without a value or day are left out."""
        reduced = rows.filter("value is not null and not isnan(value) and day is not null").groupBy("feature", "value", F.col("day").cast("date").alias("day")).agg(
            F.count(F.lit(1)).alias("n"))
        reduced = reduced.withColumn("month", F.date_format("day", "yyyy-MM"))
        reduced.repartitionByRange("day", "feature", "value").write.mode("overwrite").partitionBy("month").parquet(f"{self.root}/days/batch={batch}")

    def _meta(self, batch: int) -> tuple[dt.date, int] | None:
        row = self.spark.read.schema(_META).parquet(f"{self.root}/meta/v={batch}").first() if batch >= 0 else None
        return (row.as_of, row.n_days) if row and row.as_of else None

    def advance(self, batch: int, as_of: dt.date | None = None) -> DataFrame:
        """The window (``feature``, ``value``, ``n``) that ends with the day ``as_of`` (the newest day that was stored, if
        not given), with all batches up to ``batch``; written as this batch's version."""
        days = self.spark.read.schema(_DAYS).option("basePath", f"{self.root}/days").parquet(f"{self.root}/days").filter(F.col("batch") <= batch)
        before = self._meta(batch - 1)
        if as_of is None:
            newest = days.agg(F.max("day")).first()[0]
            as_of = max((d for d in (newest, before[0] if before else None) if d), default=None)
        own = _window_days(as_of, self.n_days)
        old = _window_days(*before) if before else set()
        # folders first (batch and month), then the days whose place in the window has changed
        now, was = F.col("day").isin(own), (F.col("batch") < batch) & F.col("day").isin(old)
        folders = ((F.col("batch") == batch) & F.col("month").isin(_months(own))) | ((F.col("batch") < batch) & F.col("month").isin(_months(own ^ old)))
        changed = days.filter(folders).filter(now != was).select("feature", "value", F.when(now, F.col("n")).otherwise(-F.col("n")).alias("n"))
        if before:
            changed = changed.unionByName(self.spark.read.schema(_WINDOW).parquet(f"{self.root}/window/v={batch - 1}"))
        counts = changed.groupBy("feature", "value").agg(F.sum("n").alias("n")).filter("n <> 0")
        counts.write.mode("overwrite").parquet(f"{self.root}/window/v={batch}")
        self.spark.createDataFrame([(as_of, self.n_days)], _META).write.mode("overwrite").parquet(f"{self.root}/meta/v={batch}")
        return self.spark.read.schema(_WINDOW).parquet(f"{self.root}/window/v={batch}")


def report_of_window(reference: DataFrame, window: DataFrame, min_production: int = MIN_PRODUCTION_VALUES) -> DataFrame:
    """H10 of a window's counts against ``reference`` (``reduce_values`` of reference rows); features that the reference
    does not know are left out (J7)."""
    known = reference.filter("n_ref > 0").select("feature").distinct()
    prod = window.join(F.broadcast(known), "feature", "left_semi").select("feature", "value", F.lit(0).cast("long").alias("n_ref"), F.col("n").alias("n_prod"))
    both = reference.select("feature", "value", "n_ref", F.lit(0).cast("long").alias("n_prod")).unionByName(prod)
    return report_from_reduced(both.groupBy("feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_prod").alias("n_prod")), min_production=min_production)


def drift_last_days(reference_long: DataFrame, batches: Sequence[DataFrame], n_days: int, root: str) -> DataFrame:
    """The report over the last ``n_days`` days of rows (``day``, ``feature``, ``value``) that come in batches."""
    window = DayWindow(reference_long.sparkSession, root, n_days)
    counts = None
    for i, rows in enumerate(batches):
        window.add(rows, i)
        counts = window.advance(i)
    return report_of_window(reduce_values(reference_long.filter(F.col("side") == REF)), counts)
