"""A linear classifier from one aggregate: Gaussian discriminant analysis with a common variance per feature.

Its log odds are linear, ``coefficient = (mean of class 1 - mean of class 0) /
variance`` with the variance within the classes, so the whole fit is one
grouped aggregate over the rows and needs no iteration: a baseline model that
trains at any size in one pass, and whose coefficients SQL can derive as well.
A feature that does not vary within the classes has the coefficient 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(intercept)"


def long_features(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, y, x) of scalar columns; rows without a label or a value are left out."""
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
    long = df.select(F.col(label).cast("int").alias("y"), *cols).unpivot(["y"], list(features), "feature", "x")
    return long.filter("y in (0, 1) and x is not null and not isnan(x)")


def long_array(df: DataFrame, array: str, names: Sequence[str], label: str) -> DataFrame:
    """(feature, y, x) of an array column whose places have ``names``."""
    place = F.posexplode(F.col(array)).alias("i", "x")
    long = df.select(F.col(label).cast("int").alias("y"), place)
    named = F.array(*[F.lit(n) for n in names])
    return long.select(F.get(named, F.col("i")).alias("feature"), "y", F.col("x").cast("double").alias("x")).filter(
        "feature is not null and y in (0, 1) and x is not null and not isnan(x)")


def fit_discriminant(long: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """The model as a table (feature, coefficient) from ``long`` (feature, y, x); ``rows`` gives the classes' shares."""
    of = lambda c: F.when(F.col("y") == c, F.col("x"))
    a = long.groupBy("feature").agg(F.count(of(0)).alias("n0"), F.count(of(1)).alias("n1"), F.avg(of(0)).alias("m0"), F.avg(of(1)).alias("m1"),
                                    F.var_pop(of(0)).alias("v0"), F.var_pop(of(1)).alias("v1"))
    within = (F.col("n0") * F.col("v0") + F.col("n1") * F.col("v1")) / (F.col("n0") + F.col("n1"))
    a = a.withColumn("v", within).select("feature", "m0", "m1", F.when(F.col("v") > 0, F.col("v")).alias("v"))
    each = a.select("feature", F.coalesce((F.col("m1") - F.col("m0")) / F.col("v"), F.lit(0.0)).alias("coefficient"),
                    F.coalesce((F.col("m0") ** 2 - F.col("m1") ** 2) / (2 * F.col("v")), F.lit(0.0)).alias("constant"))
    y = F.col(label)
    odds = rows.agg(F.log(F.try_divide(F.count_if(y == 1), F.count_if(y == 0)))).scalar()
    constant = each.agg((F.sum("constant") + F.coalesce(odds, F.lit(0.0))).alias("coefficient"))
    return each.select("feature", "coefficient").unionByName(constant.select(F.lit(INTERCEPT).alias("feature"), "coefficient"))
