"""Batch scoring.

The reference scores one row per call; here a whole DataFrame is scored in one
pass.  A fitted model becomes column expressions (``expressions.py``), which
Spark compiles with the rest of the plan; a model that has no expression is
scored by ``transform``.  The model's top-5 importances are model metadata
(five pairs), attached as a literal array column — no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurewatch.functions.derive import DECISION_THRESHOLD, risk_band, risk_label
from featurewatch.ml.expressions import Compiled, compile_model


def with_probability(model: PipelineModel | Compiled, df: DataFrame, name: str = "__p") -> DataFrame:
    """``df`` with the probability of class 1."""
    if not isinstance(model, Compiled):
        try:
            model = compile_model(model)
        except ValueError:                                 # a stage without an expression
            return model.transform(df).withColumn(name, vector_to_array(F.col("probability"))[1])
    return df.withColumn(name, model.probability())


def top_factors_of(factors: Sequence[tuple[str, float]], n: int = 5) -> Column:
    """The first ``n`` (feature, importance) pairs as a literal array."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("importance")) for f, v in list(factors)[:n]]) if factors else \
        F.array().cast("array<struct<feature:string,importance:double>>")


def score_batch(model: PipelineModel | Compiled, df: DataFrame, model_id: str, keep: Sequence[str] = (),
                top_factors: Sequence[tuple[str, float]] = (), threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Prediction at 0.5, probability (band on the UNROUNDED value,
    reported rounded to 4), label text, top factors and model id."""
    return with_probability(model, df).select(*keep, F.col("__p")).select(
        *keep,
        (F.col("__p") >= threshold).cast("int").alias("prediction"),
        F.round("__p", 4).alias("probability"),
        risk_band(F.col("__p")).alias("risk_level"),
        risk_label((F.col("__p") >= threshold).cast("int")).alias("label"),
        top_factors_of(top_factors).alias("top_factors"),
        F.lit(model_id).alias("model_id"))
