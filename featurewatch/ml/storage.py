"""Model artefacts, metadata index and reference samples.

Models are Spark ML ``PipelineModel`` directories under the shared storage
root; the index is an append-only JSON-lines table (one line per saved
model), read with an explicit schema; the reference sample is a Parquet
table partitioned by ``model_id``.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurewatch.ml.split import reference_sample
from featurewatch.session import storage_path
from featurewatch.sources.requests import MODEL_INDEX_SCHEMA, flatten_model_index, read_model_index

PREFIX = {"xgboost": "xgb", "catboost": "cat", "lightgbm": "lgb", "logistic_regression": "lr", "svm": "svm"}


def new_model_id(model_type: str, when: _dt.datetime | None = None) -> str:
    """S12 id: type prefix + timestamp (``xgb_20260216_094158``) and a random end, so
    that two trainings within a second do not meet."""
    when = when or _dt.datetime.now(_dt.timezone.utc)
    return f"{PREFIX.get(model_type, model_type)}_{when.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:8]}"


def index_path(spark: SparkSession) -> str:
    return storage_path(spark, "models", "index")


def save_trained_model(spark: SparkSession, model: PipelineModel, model_type: str, metrics: dict,
                       feature_names: Sequence[str], n_training_samples: int, train_df: DataFrame | None = None,
                       key: str | None = None, model_id: str | None = None) -> str:
    """Model + one index line + reference sample (S13); returns the id."""
    mid = model_id or new_model_id(model_type)
    model.write().save(storage_path(spark, "models", mid))       # an id is never overwritten
    row = {"model_id": mid, "model_type": model_type,
           "trained_at": _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat(timespec="seconds"),
           "metrics": {k: float(v) for k, v in metrics.items()},
           "feature_count": len(feature_names), "n_training_samples": int(n_training_samples)}
    spark.createDataFrame([json.dumps(row)], "string").coalesce(1).write.mode("append").text(index_path(spark))
    if train_df is not None and key is not None:
        (reference_sample(train_df, key).withColumn("model_id", F.lit(mid))
         .write.mode("append").partitionBy("model_id").parquet(storage_path(spark, "reference")))
    return mid


def model_index(spark: SparkSession) -> DataFrame:
    return read_model_index(spark, index_path(spark))


def model_leaderboard(index: DataFrame) -> DataFrame:
    """O1: models newest first (flattened metrics)."""
    return flatten_model_index(index).orderBy(F.col("trained_at").desc(), F.col("model_id").desc())


def model_latest(index: DataFrame) -> DataFrame:
    """O2: id of the newest model (one row; NULL when the index is empty)."""
    flat = flatten_model_index(index)
    return flat.agg(F.max_by("model_id", F.struct("trained_at", "model_id")).alias("model_id"),
                    F.count(F.lit(1)).alias("n_models"))


def load_trained_model(spark: SparkSession, model_id: str | None = None) -> tuple[str, PipelineModel]:
    """By id or the latest; error when no model exists."""
    if model_id is None:
        model_id = model_latest(model_index(spark)).first()["model_id"]
        if model_id is None:
            raise FileNotFoundError("no trained model in the index")
    return model_id, PipelineModel.load(storage_path(spark, "models", model_id))


def load_reference_data(spark: SparkSession, model_id: str | None = None) -> DataFrame | None:
    """The stored reference sample of a model, by id or of the latest one that has a
    sample; ``None`` if there is none.  Other errors are raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(storage_path(spark, "reference"))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    df = spark.read.parquet(storage_path(spark, "reference"))
    if model_id is None:
        with_sample = df.select("model_id").distinct().join(flatten_model_index(model_index(spark)), "model_id", "left_semi")
        ranked = flatten_model_index(model_index(spark)).join(with_sample, "model_id")
        model_id = ranked.agg(F.max_by("model_id", F.struct("trained_at", "model_id"))).first()[0]
    own = df.filter(F.col("model_id") == model_id)
    return None if model_id is None or own.isEmpty() else own


def top_n_importance(importances: DataFrame, n: int = 10) -> DataFrame:
    """Top-n importances, descending (a top-k report)."""
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


__all__ = ["MODEL_INDEX_SCHEMA", "save_trained_model", "model_index", "model_leaderboard", "model_latest",
           "load_trained_model", "load_reference_data", "top_n_importance", "new_model_id"]
