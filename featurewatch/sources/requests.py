"""Request bodies and JSON metadata sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def explode_json_requests(df: DataFrame, body_col: str, item_schema: T.StructType,
                          keep: Sequence[str] = ()) -> DataFrame:
    """A column of JSON arrays (batch request bodies) -> one row per item.
    Unparseable bodies yield no rows (``from_json`` gives NULL)."""
    parsed = df.select(*keep, F.explode(F.from_json(body_col, T.ArrayType(item_schema))).alias("__it"))
    return parsed.select(*keep, "__it.*")


MODEL_INDEX_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("trained_at", T.StringType()),
    T.StructField("metrics", T.StructType([
        T.StructField(n, T.DoubleType()) for n in ("accuracy", "precision", "recall", "f1_score", "auc_roc")])),
    T.StructField("feature_count", T.IntegerType()),
    T.StructField("n_training_samples", T.LongType()),
])


def _index_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the index files, parsed or NULL.  A file holds one JSON object per line or one JSON array."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    schema = T.StructType([*MODEL_INDEX_SCHEMA.fields, T.StructField("__bad", T.StringType())])
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    lines = F.filter(F.split("v", r"\r?\n"), lambda x: F.trim(x) != "")
    listed = whole.filter("v like '[%'").select(F.explode_outer(F.from_json("v", T.ArrayType(MODEL_INDEX_SCHEMA))).alias("m"))
    listed = listed.select(F.when(F.col("m").isNotNull(), F.struct("m.*", F.lit(None).cast("string").alias("__bad"))).alias("m"))
    single = whole.filter("not v like '[%'").select(F.explode(lines).alias("line")).select(F.from_json("line", schema, options).alias("m"))
    return listed.unionByName(single)


def read_model_index(spark: SparkSession, path: str) -> DataFrame:
    """Model index, as JSON lines or as a JSON array; an absent index is an empty table.  Entries that cannot be
    read are left out here and counted by ``unreadable_index_entries``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], MODEL_INDEX_SCHEMA)
    entries = _index_entries(spark, path).filter("m is not null and m.__bad is null and m.model_id is not null")
    return entries.select(*[F.col(f"m.{f.name}").alias(f.name) for f in MODEL_INDEX_SCHEMA.fields])


def unreadable_index_entries(spark: SparkSession, path: str) -> int:
    return _index_entries(spark, path).filter("m is null or m.__bad is not null or m.model_id is null").count()


def flatten_model_index(index: DataFrame) -> DataFrame:
    """One flat row per model with typed time and metrics."""
    return index.select(
        "model_id", "model_type", F.to_timestamp("trained_at").alias("trained_at"),
        *[F.col(f"metrics.{m}").alias(m) for m in ("accuracy", "precision", "recall", "f1_score", "auc_roc")],
        "feature_count", "n_training_samples")
