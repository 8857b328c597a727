"""Model zoo on Spark ML (M4-M7): estimator factory, presets and grids.

The reference's boosted-tree libraries become presets of ``GBTClassifier``
(depth, rounds, learning rate, row/column subsampling, minimum leaf size,
minimum gain, bins).  Leaf L1/L2 penalties have no Spark equivalent and are
dropped.  An unlimited depth (-1) becomes 30, the deepest tree that Spark
builds.  The logistic penalty is Spark's elastic net: l1 is 1, l2 is 0.  Kernel SVM is not built; the linear SVM gets probabilities from a
logistic fit on its margin.  Every pipeline starts with an imputer + vector
assembly, because Spark trees reject NaN vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.tuning import ParamGridBuilder

from featurewatch.ml.median import ExactMedianImputer

SEED = 42

# ---- fixed values: default parameters of the reference's model catalogue ----
PRESETS = {
    "xgboost": {"max_depth": 4, "min_child_weight": 5, "subsample": 0.8, "colsample_bytree": 0.8,
                "learning_rate": 0.1, "n_estimators": 200},
    "catboost": {"depth": 4, "iterations": 200, "learning_rate": 0.1, "subsample": 0.8, "border_count": 128},
    "lightgbm": {"max_depth": 4, "n_estimators": 200, "learning_rate": 0.1, "subsample": 0.8,
                 "colsample_bytree": 0.8, "min_child_samples": 20},
    "logistic_regression": {"C": 1.0, "max_iter": 1000, "class_weight": "balanced"},
    "svm": {"C": 1.0, "class_weight": "balanced"},
}
GRIDS = {
    "xgboost": {"n_estimators": [100, 200, 300, 500], "max_depth": [3, 4, 5, 6, 7],
                "learning_rate": [0.01, 0.05, 0.1, 0.2], "subsample": [0.7, 0.8, 0.9, 1.0],
                "colsample_bytree": [0.7, 0.8, 0.9, 1.0], "min_child_weight": [1, 3, 5],
                "gamma": [0, 0.1, 0.2, 0.3]},
    "catboost": {"iterations": [100, 200, 300, 500], "depth": [3, 4, 5, 6, 7, 8],
                 "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2], "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
                 "border_count": [32, 64, 128, 254]},
    "lightgbm": {"n_estimators": [100, 200, 300, 500], "max_depth": [3, 4, 5, 6, 7, -1],
                 "learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2], "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
                 "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0], "min_child_samples": [5, 10, 20, 50]},
    "logistic_regression": {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"], "max_iter": [500, 1000, 2000]},
    "svm": {"C": [0.01, 0.1, 1.0, 10.0, 100.0]},
}
# -----------------------------------------------------------------------------

TREE_TYPES = ("xgboost", "catboost", "lightgbm")
MODEL_TYPES = tuple(PRESETS)

# reference parameter name -> Spark GBT parameter
_GBT_PARAM = {
    "max_depth": "maxDepth", "depth": "maxDepth", "n_estimators": "maxIter", "iterations": "maxIter",
    "learning_rate": "stepSize", "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy",
    "min_child_weight": "minInstancesPerNode", "min_child_samples": "minInstancesPerNode",
    "gamma": "minInfoGain", "border_count": "maxBins",
}


def supports_hyperparam_search(model_type: str) -> bool:
    return model_type in GRIDS and bool(GRIDS[model_type])


def _gbt_kwargs(params: dict) -> dict:
    out = {}
    for k, v in params.items():
        if k not in _GBT_PARAM:
            continue
        name = _GBT_PARAM[k]
        if name == "featureSubsetStrategy":
            v = "all" if float(v) >= 1.0 else str(float(v))
        elif name in ("maxDepth", "maxIter", "minInstancesPerNode", "maxBins"):
            v = int(v)
            if name == "maxDepth" and v <= 0:
                v = 30
        else:
            v = float(v)
        out[name] = v
    return out


def _prep_stages(features: Sequence[str], vector_col: str | None):
    if vector_col:
        return [], vector_col
    imputed = [f"{c}__imp" for c in features]
    imp = ExactMedianImputer(inputCols=list(features), outputCols=imputed)
    asm = VectorAssembler(inputCols=imputed, outputCol="features", handleInvalid="keep")
    return [imp, asm], "features"


def create_estimator(model_type: str, features: Sequence[str] = (), label: str = "label",
                     weight_col: str | None = None, params: dict | None = None,
                     vector_col: str | None = None, n_rows: int | None = None) -> Pipeline:
    """M4-M6: preset (+ overrides) -> Spark ML pipeline.  Unknown type -> ValueError."""
    if model_type not in PRESETS:
        raise ValueError(f"unknown model type {model_type!r}; known: {list(PRESETS)}")
    p = {**PRESETS[model_type], **(params or {})}
    stages, fcol = _prep_stages(features, vector_col)
    if model_type in TREE_TYPES:
        kw = _gbt_kwargs(p)
        est = GBTClassifier(featuresCol=fcol, labelCol=label, seed=SEED, **kw)
        if weight_col:
            est.setWeightCol(weight_col)
        return Pipeline(stages=stages + [est])
    if model_type == "logistic_regression":
        # sklearn C is the inverse of the summed L2 penalty; Spark's regParam is per-row averaged
        reg = 1.0 / (float(p["C"]) * max(1, n_rows or 1))
        est = LogisticRegression(featuresCol=fcol, labelCol=label, regParam=reg, elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0,
                                 standardization=False, maxIter=int(p["max_iter"]))
        if weight_col:
            est.setWeightCol(weight_col)
        return Pipeline(stages=stages + [est])
    # linear SVM on standardised features, probability from a logistic fit on the margin
    scaler = StandardScaler(inputCol=fcol, outputCol="__scaled", withMean=True, withStd=True)
    svc = LinearSVC(featuresCol="__scaled", labelCol=label, regParam=1.0 / (float(p["C"]) * max(1, n_rows or 1)),
                    rawPredictionCol="__svc_raw", predictionCol="__svc_pred")
    if weight_col:
        svc.setWeightCol(weight_col)
    margin = VectorSlicer(inputCol="__svc_raw", outputCol="__margin", indices=[1])
    platt = LogisticRegression(featuresCol="__margin", labelCol=label)
    return Pipeline(stages=stages + [scaler, svc, margin, platt])


def param_grid(pipeline: Pipeline, model_type: str, n_rows: int | None = None):
    """M7: Spark ParamMaps for the model type's grid (on the final estimator)."""
    if model_type not in GRIDS:
        raise ValueError(f"unknown model type {model_type!r}")
    stages = pipeline.getStages()
    est = stages[-1] if model_type != "svm" else stages[-3]
    b = ParamGridBuilder()
    for k, values in GRIDS[model_type].items():
        if model_type in TREE_TYPES:
            if k not in _GBT_PARAM:
                continue
            name = _GBT_PARAM[k]
            conv = [_gbt_kwargs({k: v})[name] for v in values]
            b = b.addGrid(est.getParam(name), sorted(set(conv), key=str))
        elif k == "C":
            b = b.addGrid(est.getParam("regParam"), [1.0 / (c * max(1, n_rows or 1)) for c in values])
        elif k == "max_iter":
            b = b.addGrid(est.getParam("maxIter"), values)
        elif k == "penalty":
            b = b.addGrid(est.getParam("elasticNetParam"), [1.0 if v == "l1" else 0.0 for v in values])
    return b.build()
