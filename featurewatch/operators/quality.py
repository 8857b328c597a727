"""Data-quality profiles (S17, A13-A15): one wide aggregate per table,
unpivoted to one row per column — a single scan however many columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Quality tiers of the reference's data analysis and the
# correlation level at which it removed leak-prone features.
NULL_TIER_LOW = 0.30
NULL_TIER_HIGH = 0.60
LEAKAGE_CORR = 0.5


def _q(c):
    return F.col(f"`{c}`")


def column_profile(df: DataFrame, cols: Sequence[str], numeric: bool = True) -> DataFrame:
    """Per column: rows, nulls, null rate and (numeric) min / max / mean."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.count(_q(c)).alias(f"nn{i}")]
        if numeric:
            aggs += [F.min(_q(c)).cast("double").alias(f"mi{i}"), F.max(_q(c)).cast("double").alias(f"ma{i}"),
                     F.avg(_q(c)).alias(f"av{i}")]
    a = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        fields = [F.lit(c).alias("feature"), F.col("__n").alias("n_rows"), F.col(f"nn{i}").alias("n_non_null")]
        if numeric:
            fields += [F.col(f"mi{i}").alias("min"), F.col(f"ma{i}").alias("max"), F.col(f"av{i}").alias("mean")]
        rows.append(F.struct(*fields))
    out = a.select(F.inline(F.array(*rows)))
    return out.withColumn("n_null", F.col("n_rows") - F.col("n_non_null")) \
        .withColumn("null_rate", F.round(F.try_divide(F.col("n_null"), F.col("n_rows")), 6))


def null_profile_tiers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and rate per column with the tiers < 30 %, 30-60 %, > 60 %."""
    cols = list(cols or df.columns)
    p = column_profile(df, cols, numeric=False)
    r = F.col("null_rate")
    tier = F.when(r < NULL_TIER_LOW, "low").when(r <= NULL_TIER_HIGH, "medium").otherwise("high")
    return p.select(F.col("feature").alias("column_name"), "n_rows", "n_null", "null_rate", tier.alias("tier"))


def feature_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, max, mean (rounded 6) and non-null count of each column."""
    p = column_profile(df, cols)
    return p.select("feature", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"),
                    F.round("mean", 6).alias("mean"), "n_non_null")


def leakage_screen(df: DataFrame, target: str, features: Sequence[str], threshold: float = LEAKAGE_CORR) -> DataFrame:
    """Pearson correlation of each feature with the target; |r| above the
    threshold flags a leak suspect.  One aggregate with one ``corr`` per feature."""
    a = df.agg(*[F.corr(_q(f).cast("double"), _q(target).cast("double")).alias(f"c{i}")
                 for i, f in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("corr"))
                     for i, f in enumerate(features)])
    out = a.select(F.inline(rows))
    return out.select("feature", F.round("corr", 6).alias("corr"),
                      F.coalesce(F.abs("corr") > threshold, F.lit(False)).alias("leak_suspect"))


def catalog_profile(df: DataFrame, catalog: Sequence[tuple[str, str, str, bool]]) -> DataFrame:
    """Declared feature catalog (feature, category, description, is_default)
    joined with the table profile; absent features keep NULL statistics; each
    row carries its category rollup (count of present features, mean null rate).
    The catalog is declared configuration (one row per feature), so it is broadcast."""
    cat = df.sparkSession.createDataFrame(
        list(catalog), "feature string, category string, description string, is_default boolean")
    prof = column_profile(df, [f for f, *_ in catalog if f in df.columns])
    j = F.broadcast(cat).join(prof, "feature", "left")
    w = Window.partitionBy("category")
    return j.select("feature", "category", "is_default", F.col("n_rows").isNotNull().alias("present"), "n_rows",
                    "null_rate", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"),
                    F.count("n_rows").over(w).alias("category_n_present"),
                    F.round(F.avg("null_rate").over(w), 6).alias("category_null_rate"))
