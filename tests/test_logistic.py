"""Logistic fits iterated together (ml/logistic.py) against Spark's own fits."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featurewatch.ml import evaluate as EV
from featurewatch.ml import zoo as Z
from featurewatch.ml.logistic import ALL, FoldFits, supports


def _rows(spark, n=400):
    """Missing values, a constant, a nearly repeated column, weights, and every row twice."""
    x, i = (F.col("id") * 7919 % 101) / 100.0, F.col("id")
    y = (x + (i % 7) / 20.0 > 1.0).cast("int")
    df = spark.range(n).select("id", F.when(i % 17 > 0, x).alias("a"), (i % 5).cast("double").alias("b"), (i % 5 * 2 + i % 2).cast("double").alias("b2"),
                               F.lit(3.3).alias("c"), y.alias("y"), F.when(y == 1, 2.3).otherwise(0.77).alias("w"), (i % 2).cast("int").alias("fold"))
    return df.unionByName(df.withColumn("id", i + n)).cache()


FEATURES = ["a", "b", "b2", "c"]


def test_fits_together_are_those_of_spark(spark):
    df = _rows(spark)
    pipe = Z.create_estimator("logistic_regression", FEATURES, "y", "w", n_rows=800)
    fits = FoldFits(df, pipe, [0, ALL])
    assert supports(pipe) and fits.usable and fits.rows.count() <= 400              # equal rows are one row
    kinds = [(1e-4, 0.0), (0.1, 0.0), (1e-3, 1.0), (0.01, 1.0), (1e-3, 0.5)]
    jobs = [(0, {"regParam": reg, "elasticNetParam": mix}, [3, 12]) for reg, mix in kinds]
    assert fits.small
    by_task = fits.fit(jobs)
    fits.small = False
    got = fits.fit(jobs)                                             # by passes of many tasks: the same steps
    for one, other in zip(by_task, got, strict=True):
        assert one.keys() == other.keys() and all(np.allclose(one[n], other[n], rtol=1e-9, atol=1e-11) for n in one)
    est = pipe.getStages()[-1]
    train = fits.common[0].transform(df.filter("fold != 0")).cache()
    for (reg, mix), found in zip(kinds, got, strict=True):
        for limit in (3, 12):
            last = est.fit(train, {est.regParam: reg, est.elasticNetParam: mix, est.maxIter: limit})
            np.testing.assert_allclose(found[limit], [*last.coefficients, last.intercept], rtol=1e-7, atol=1e-9)
    params = {est.regParam: 0.1, est.maxIter: 12}
    mine, want = fits.model(ALL, fits.fit([(ALL, {"regParam": 0.1}, [12])])[0][12], params), pipe.fit(df, params)
    assert mine.stages[0].getMedians() == want.stages[0].getMedians()
    named = [{p.name: v for p, v in m.stages[-1].extractParamMap().items()} for m in (mine, want)]
    assert named[0] == named[1]
    scores = [sorted((r.id, round(r.p1, 9), r.yhat) for r in EV.scored(m, df).collect()) for m in (mine, want)]
    assert scores[0] == scores[1]
    fits.close()


def test_a_search_passes_over_the_rows_by_iterations_not_by_candidates(spark, monkeypatch):
    """Failed when each candidate had a fit of its own in each fold."""
    df = _rows(spark).drop("fold")
    pipe = Z.create_estimator("logistic_regression", FEATURES, "y", "w", n_rows=800)
    grid = [c for c in Z.param_grid(pipe, "logistic_regression", 800) if 0.0 in c.values()][:9]
    fits, passes, fit, one_pass = [], [], LogisticRegression._fit, FoldFits._pass
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    monkeypatch.setattr(FoldFits, "_pass", lambda self, *a: passes.append(1) or one_pass(self, *a))
    model, table = EV.random_search(df, pipe, grid, "y", "id", folds=2)
    assert len(grid) == 9 and not fits and len(passes) < 10
    assert table.count() == 9 and EV.scored(model, df).count() == 800


def test_vectors_and_rows_that_spark_must_judge(spark):
    df = _rows(spark)
    vectors = df.select("id", array_to_vector(F.array("b", "b2")).alias("features"), "y", "fold")
    pipe = Z.create_estimator("logistic_regression", label="y", vector_col="features", n_rows=800)
    fits = FoldFits(vectors, pipe, [1])
    found = fits.fit([(1, {}, [100])])[0][100]
    last = pipe.fit(vectors.filter("fold != 1"), {pipe.getStages()[-1].maxIter: 100}).stages[-1]
    np.testing.assert_allclose(found, [*last.coefficients, last.intercept], rtol=1e-7, atol=1e-9)
    assert not FoldFits(vectors.filter("y = 1"), pipe, [1]).usable                   # one class
    assert not FoldFits(vectors.withColumn("y", F.when(F.col("id") > 3, F.col("y"))), pipe, [1]).usable
    assert not FoldFits(vectors.withColumn("y", F.col("y") * 2), pipe, [1]).usable
    assert not FoldFits(vectors.withColumn("features", F.when(F.col("id") > 3, F.col("features"))), pipe, [1]).usable
    assert not FoldFits(vectors.filter("id < 0"), pipe, [1]).usable
    assert not supports(Z.create_estimator("svm", FEATURES, "y")) and not supports(Z.create_estimator("xgboost", FEATURES, "y"))


def test_one_class_falls_back_to_the_fit_of_spark(spark):
    df = _rows(spark, 100).select("id", "a", "b", F.lit(1).alias("y"), F.lit(1.0).alias("w"))
    pipe = Z.create_estimator("logistic_regression", ["a", "b"], "y", "w", n_rows=200)
    model, table = EV.random_search(df, pipe, Z.param_grid(pipe, "logistic_regression", 200)[:2], "y", "id", folds=2)
    assert [r.mean_f1 for r in table.collect()] == [1.0, 1.0] and EV.scored(model, df).filter("yhat = 1").count() == 200
