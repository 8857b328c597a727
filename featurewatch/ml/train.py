"""The training run (M13): split, class weights, search or fit, evaluation, importances, cross-validation, saving."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurewatch.functions.project import select_features, select_features_subset
from featurewatch.ml import evaluate as EV
from featurewatch.ml import storage as ST
from featurewatch.ml import zoo as Z
from featurewatch.ml.split import stratified_split, weighted
from featurewatch.operators import classify as C
from featurewatch.session import materialize

WEIGHT = "weight"


@dataclass
class Run:
    """What one training run leaves: frames are lazy, the model is fitted."""
    model_id: str
    model_type: str
    model: PipelineModel
    features: list[str]
    n_train: int
    n_test: int
    metrics: DataFrame
    confusion: DataFrame
    report: DataFrame
    importances: DataFrame
    candidates: DataFrame | None
    cv: DataFrame | None


def fit_weighted(train: DataFrame, model_type: str, label: str, key: str, features: Sequence[str] = (),
                 vector_col: str | None = None, params: dict | None = None, optimize: bool = False,
                 n_iter: int = EV.N_ITER) -> tuple[PipelineModel, DataFrame | None, DataFrame, int]:
    """A model trained with its type's class weights (M2, M3), by the preset or by search over the whole grid or
    ``n_iter`` of it (M8).  Gives the model, the candidates (None without search), the weighted rows and their number."""
    rows = materialize(weighted(train, label, model_type, WEIGHT))
    n = rows.count()
    pipe = Z.create_estimator(model_type, features, label, WEIGHT, params, vector_col, n)
    if optimize and Z.supports_hyperparam_search(model_type):
        model, table = EV.random_search(rows, pipe, Z.param_grid(pipe, model_type, n), label, key, n_iter)
        return model, table, rows, n
    return pipe.fit(rows), None, rows, n


def run_training(df: DataFrame, key: str, label: str, wanted: Sequence[str], model_type: str = "xgboost",
                 selected: Sequence[str] | None = None, optimize: bool = True, n_iter: int = EV.N_ITER,
                 run_cv: bool = True, save: bool = True) -> Run:
    """M13 on a table of engineered features: P1, P2, M1, weights, M8 or M4-M6, A8-A11, M12, M10, S12."""
    have = select_features(df, [key, *wanted], target=label)
    features = [c for c in have.columns if c not in (key, label)]
    if selected:
        have = select_features_subset(have, selected, keep=[key, label])
        features = [c for c in have.columns if c not in (key, label)]
    rows = have.select(key, F.col(label).cast("int").alias(label), *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    split = materialize(stratified_split(rows, key, label))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    model, candidates, _, n = fit_weighted(train, model_type, label, key, features, optimize=optimize, n_iter=n_iter)
    scored = materialize(EV.scored(model, test).select(key, label, "p1", "yhat"))
    metrics = EV.metrics(scored, label)
    importances = EV.importance_table(df.sparkSession, EV.importances(model, test, features, label, key))
    cv = None
    if run_cv:
        whole = weighted(split.drop("split"), label, model_type, WEIGHT)         # the stored rows, not the features again
        cv = EV.cross_validate(whole, lambda: Z.create_estimator(model_type, features, label, WEIGHT, n_rows=n), label, key)
    model_id = ST.new_model_id(model_type)
    if save:
        ST.save_trained_model(df.sparkSession, model, model_type, metrics.first().asDict(), features, n, train.drop("split"), key, model_id)
    return Run(model_id, model_type, model, features, n, test.count(), metrics, C.confusion_counts(scored, label, "yhat"),
               C.classification_report(scored, label, "yhat"), importances, candidates, cv)
