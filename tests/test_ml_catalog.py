"""Model zoo, splits, storage, JSON sources and quality profiles
(the reference's registry / storage / training contracts)."""

from __future__ import annotations

import json

import pytest
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featurewatch.ml import evaluate as EV
from featurewatch.ml import split as SP
from featurewatch.ml import storage as ST
from featurewatch.ml import train as TR
from featurewatch.ml import zoo as Z
from featurewatch.operators import quality as QU
from featurewatch.sources import requests as RQ


def test_zoo_presets_and_errors(spark):
    with pytest.raises(ValueError):
        Z.create_estimator("nope", vector_col="features")
    gbt = Z.create_estimator("xgboost", vector_col="features").getStages()[-1]
    assert isinstance(gbt, GBTClassifier)
    assert (gbt.getMaxDepth(), gbt.getMaxIter(), gbt.getStepSize(), gbt.getSubsamplingRate(),
            gbt.getMinInstancesPerNode(), gbt.getFeatureSubsetStrategy()) == (4, 200, 0.1, 0.8, 5, "0.8")
    assert Z.create_estimator("catboost", vector_col="features").getStages()[-1].getMaxBins() == 128
    lr = Z.create_estimator("logistic_regression", vector_col="features", n_rows=100).getStages()[-1]
    assert isinstance(lr, LogisticRegression) and lr.getRegParam() == pytest.approx(0.01) and lr.getMaxIter() == 1000
    svm = Z.create_estimator("svm", vector_col="features").getStages()
    assert any(isinstance(s, LinearSVC) for s in svm) and isinstance(svm[-1], LogisticRegression)
    assert Z.supports_hyperparam_search("xgboost") and not Z.supports_hyperparam_search("tabpfn")


def test_param_grids(spark):
    lr = Z.create_estimator("logistic_regression", vector_col="features", n_rows=10)
    assert len(Z.param_grid(lr, "logistic_regression", n_rows=10)) == 6 * 2 * 3
    gbt = Z.create_estimator("lightgbm", vector_col="features")
    assert 30 in {v for m in Z.param_grid(gbt, "lightgbm")[:2000] for k, v in m.items() if k.name == "maxDepth"}
    assert len(Z.param_grid(gbt, "lightgbm")) > 100
    with pytest.raises(ValueError):
        Z.param_grid(lr, "unknown")


def test_split_folds_sample_weights(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    s = SP.stratified_split(df, "id", "y", buckets=4)
    per = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert per[(1, "test")] in (49, 50, 51) and per[(0, "test")] in (149, 150, 151)
    assert s.count() == 1000
    f = SP.stratified_folds(df, "id", "y", buckets=3)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [200] * 5
    assert SP.reference_sample(df, "id", n=100).count() == 100
    assert SP.reference_sample(df.limit(30), "id", n=100).count() == 30
    w = {r.y: r.weight for r in SP.class_weights(df, "y").collect()}
    assert w == {0: 1.0, 1: 3.0}
    b = {r.y: r.weight for r in SP.class_weights_balanced(df, "y").collect()}
    assert b[1] == pytest.approx(1000 / (2 * 250)) and b[0] == pytest.approx(1000 / (2 * 750))


def test_model_index_tolerates_corrupt_lines(spark, tmp_path):
    p = tmp_path / "index"
    p.mkdir()
    good = {"model_id": "lr_20260101_000000", "model_type": "logistic_regression",
            "trained_at": "2026-01-01T00:00:00", "metrics": {"accuracy": 0.9, "f1_score": 0.8},
            "feature_count": 3, "n_training_samples": 10}
    (p / "part-0.json").write_text(json.dumps(good) + "\n{not json\n")
    idx = RQ.read_model_index(spark, str(p))
    flat = RQ.flatten_model_index(idx).collect()
    assert len(flat) == 1 and flat[0].accuracy == 0.9
    assert RQ.unreadable_index_entries(spark, str(p)) == 1
    assert RQ.read_model_index(spark, str(tmp_path / "absent")).count() == 0
    array = tmp_path / "array"
    array.mkdir()
    (array / "index.json").write_text(json.dumps([good, {**good, "model_id": "xgb_1"}], indent=2))
    assert sorted(r.model_id for r in RQ.read_model_index(spark, str(array)).collect()) == ["lr_20260101_000000", "xgb_1"]
    assert RQ.unreadable_index_entries(spark, str(array)) == 0


def test_train_save_load_score_roundtrip(spark):
    df = spark.range(200).select(F.col("id"), array_to_vector(F.array((F.col("id") % 10).cast("float"),
                                                                       F.lit(1.0).cast("float"))).alias("features"),
                                 (F.col("id") % 10 >= 5).cast("int").alias("label"))
    model = Z.create_estimator("logistic_regression", vector_col="features", n_rows=200).fit(df)
    m = EV.metrics(EV.scored(model, df)).first()
    assert m.accuracy > 0.9 and m.auc_roc > 0.9
    mid = ST.save_trained_model(spark, model, "logistic_regression", m.asDict(), ["a", "b"], 200,
                                train_df=df.drop("features"), key="id", model_id=ST.new_model_id("logistic_regression"))
    lid, loaded = ST.load_trained_model(spark, mid)
    assert lid == mid and EV.scored(loaded, df).count() == 200
    assert ST.load_reference_data(spark, mid).count() == 200
    assert ST.load_reference_data(spark).select("model_id").distinct().first()[0] == mid
    assert ST.load_reference_data(spark, "no such model") is None
    assert ST.model_latest(ST.model_index(spark)).first().model_id == mid
    assert ST.model_leaderboard(ST.model_index(spark)).first().model_id == mid
    pairs = EV.importance_table(spark, [("a", 0.7), ("b", 0.2), ("c", 0.1)])
    assert [r.feature for r in ST.top_n_importance(pairs, 2).collect()] == ["a", "b"]
    assert len({ST.new_model_id("svm") for _ in range(50)}) == 50
    with pytest.raises(Exception, match="already exists"):
        ST.save_trained_model(spark, model, "logistic_regression", m.asDict(), ["a"], 1, model_id=mid)


def _skewed(spark, n=400):
    x = (F.col("id") * 7919 % 101) / 100.0
    return spark.range(n).select(F.col("id"), x.alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 (x + (F.col("id") % 7) / 20.0 > 1.0).cast("int").alias("y"))


def test_models_train_with_their_class_weights(spark):
    df = _skewed(spark)
    neg, pos = (df.filter(f"y = {v}").count() for v in (0, 1))
    tree = {r.y: r.weight for r in SP.weighted(df, "y", "xgboost").select("y", "weight").distinct().collect()}
    assert tree == {0: 1.0, 1: pytest.approx(neg / pos)}
    linear = {r.y: r.weight for r in SP.weighted(df, "y", "svm").select("y", "weight").distinct().collect()}
    assert linear == {0: pytest.approx((neg + pos) / 2 / neg), 1: pytest.approx((neg + pos) / 2 / pos)}
    model, table, rows, n = TR.fit_weighted(df, "logistic_regression", "y", "id", ["a", "b"])
    plain = Z.create_estimator("logistic_regression", ["a", "b"], "y", n_rows=n).fit(df)
    recall = lambda m: EV.metrics(EV.scored(m, df), "y").first().recall
    assert table is None and n == 400 and recall(model) > recall(plain)


def test_training_run(spark):
    df = _skewed(spark).withColumn("unused", F.lit("x"))
    run = TR.run_training(df, "id", "y", ["a", "b", "absent"], "logistic_regression", selected=["b", "a", "nope"], n_iter=3)
    assert run.features == ["b", "a"] and run.n_train + run.n_test == 400 and abs(run.n_test - 80) <= 2
    assert run.candidates.count() == 3 and run.cv.select("fold").distinct().count() == 5
    assert run.metrics.first().auc_roc > 0.9 and run.report.count() >= 4
    assert sorted(r.feature for r in run.importances.collect()) == ["a", "b"]
    assert ST.load_trained_model(spark, run.model_id)[0] == run.model_id and ST.load_reference_data(spark, run.model_id).count() == run.n_train
    with pytest.raises(ValueError, match="none of the selected"):
        TR.run_training(df, "id", "y", ["a"], "svm", selected=["nope"])


def test_learning_curve_takes_shares_of_each_folds_rows(spark):
    rows = SP.weighted(_skewed(spark), "y", "logistic_regression")
    make = lambda: Z.create_estimator("logistic_regression", ["a", "b"], "y", "weight", n_rows=320)
    out = {r.size: r for r in EV.learning_curve(rows, make, "y", "id", sizes=(0.2, 1.0), folds=3).collect()}
    assert set(out) == {0.2, 1.0} and out[1.0].val_mean > 0.5


def test_quality_profiles(spark):
    df = spark.createDataFrame([(1.0, None, 1), (2.0, None, 0), (None, 5.0, 1), (4.0, None, 0)],
                               "a double, b double, y int")
    tiers = {r.column_name: r.tier for r in QU.null_profile_tiers(df).collect()}
    assert tiers == {"a": "low", "b": "high", "y": "low"}
    leak = {r.feature: r.leak_suspect for r in QU.leakage_screen(df, "y", ["a"]).collect()}
    assert leak == {"a": True}
    cat = QU.catalog_profile(df, [("a", "g1", "x", True), ("zz", "g1", "absent", False)]).collect()
    got = {r.feature: (r.present, r.null_rate, r.category_n_present) for r in cat}
    assert got == {"a": (True, 0.25, 1), "zz": (False, None, 1)}


def test_random_search_fits_the_common_stages_once_a_fold(spark, monkeypatch):
    """Each candidate is scored as by a fit of the whole pipeline on the fold's own training rows."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from featurewatch.ml.median import ExactMedianImputer
    from featurewatch.ml.split import stratified_folds
    df = spark.range(240).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") * 13 % 50).cast("double")).alias("a"),
                                 (F.col("id") * 7 % 11).cast("double").alias("b"),
                                 ((F.col("id") * 13 % 50 + F.col("id") % 9) > 27).cast("int").alias("y"), F.lit(1.0).alias("w"))
    pipe = Z.create_estimator("logistic_regression", ["a", "b"], "y", "w", n_rows=240)
    grid = [c for c in Z.param_grid(pipe, "logistic_regression", 240) if 500 in c.values()][::4]
    fits, fit = [], ExactMedianImputer._fit
    monkeypatch.setattr(ExactMedianImputer, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    model, table = EV.random_search(df, pipe, grid, "y", "id", folds=3)
    assert len(grid) == 3 and len(fits) == 3 + 1                     # the folds, and the best on all rows
    assert len(model.stages) == len(pipe.getStages())
    fdf = stratified_folds(df, "id", "y", k=3, seed=EV.SEED).cache()
    ev = MulticlassClassificationEvaluator(labelCol="y", metricName="fMeasureByLabel", metricLabel=1.0)
    for r in table.collect():
        want = [ev.evaluate(pipe.fit(fdf.filter(F.col("fold") != f), grid[r.candidate]).transform(fdf.filter(F.col("fold") == f))) for f in range(3)]
        assert r.mean_f1 == pytest.approx(sum(want) / 3, abs=1e-12)
