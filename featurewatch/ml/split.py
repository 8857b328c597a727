"""Deterministic stratified split, folds and class weights.

Randomness is replaced by a hash order: rows are ranked inside each class by
``md5(key || '-' || seed)``, which is identical in any engine, repeatable
across runs and independent of partitioning.  Ranks come from the row
number by ranges, so a class holding most rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurewatch.operators.ordering import BUCKETS, global_row_number

SEED = 42
TEST_SIZE = 0.2
CV_FOLDS = 5
REFERENCE_SAMPLE_ROWS = 1000


def hash_order(key: Column, seed: int = SEED) -> tuple[Column, Column]:
    """(numeric prefix, full md5 hex) of ``key-seed``; the numeric prefix has the
    same order as the text and drives range bucketing, the text breaks ties."""
    h = F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), h


def _ranked(df: DataFrame, key: str, label: str, seed: int, buckets: int | None) -> DataFrame:
    num, txt = hash_order(F.col(key), seed)
    d = df.withColumn("__h", num).withColumn("__ht", txt)
    return global_row_number(d, ["__h", "__ht"], groups=[label], name="__rn", buckets=buckets, count="__n")


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = TEST_SIZE,
                     seed: int = SEED, buckets: int | None = BUCKETS) -> DataFrame:
    """M1: ``split`` = train when the in-class percent rank is below 1 - test_size."""
    r = _ranked(df, key, label, seed, buckets)
    prank = F.when(F.col("__n") > 1, (F.col("__rn") - 1) / (F.col("__n") - 1)).otherwise(F.lit(0.0))
    return r.withColumn("split", F.when(prank < 1 - test_size, "train").otherwise("test")) \
        .drop("__h", "__ht", "__rn", "__n")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = CV_FOLDS, seed: int = SEED,
                     buckets: int | None = BUCKETS) -> DataFrame:
    """M9: ``fold`` = (in-class hash rank - 1) mod k, so every fold has each class share."""
    r = _ranked(df, key, label, seed, buckets)
    return r.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__h", "__ht", "__rn", "__n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M2: positive-class weight n_neg / n_pos (1.0 without positives); negatives 1.0."""
    c = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ratio = F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).otherwise(F.lit(1.0))
    return c.select(F.inline(F.array(
        F.struct(F.lit(0).alias(label), F.col("neg").alias("count"), F.lit(1.0).alias("weight")),
        F.struct(F.lit(1).alias(label), F.col("pos").alias("count"), ratio.alias("weight")))))


def class_weights_balanced(df: DataFrame, label: str) -> DataFrame:
    """M3: sklearn 'balanced' weights n / (n_classes * n_class)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    n = df.agg(F.count(F.lit(1))).scalar()
    k = df.agg(F.count_distinct(label)).scalar()
    return g.select(label, "count", (n / (k * F.col("count"))).alias("weight"))


def with_weight_column(df: DataFrame, label: str, weights: DataFrame, out: str = "weight") -> DataFrame:
    """Attach per-class weights (one row per class) as an ML ``weightCol``; a row
    without a label weighs 1."""
    w = weights.select(F.col(label).alias("__label"), F.col("weight").cast("double").alias(out))
    return df.join(w, df[label] == F.col("__label"), "left").drop("__label").fillna({out: 1.0})


def weighted(df: DataFrame, label: str, model_type: str, out: str = "weight") -> DataFrame:
    """The class weights that a model type trains with: positives by n_neg / n_pos
    for boosted trees (M2), balanced for the linear models (M3)."""
    make = class_weights_balanced if model_type in ("logistic_regression", "svm") else class_weights
    return with_weight_column(df, label, make(df, label), out)


def reference_sample(df: DataFrame, key: str, n: int = REFERENCE_SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, deterministic:
    the ``n`` smallest hash keys (a top-k plan, bounded by ``n``)."""
    num, txt = hash_order(F.col(key), seed)
    return (df.withColumn("__h", num).withColumn("__ht", txt)
            .orderBy("__h", "__ht").limit(n).drop("__h", "__ht"))
