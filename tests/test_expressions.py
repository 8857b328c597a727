"""Models as column expressions, importances, the discriminant model and scoring."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from featurewatch.ml import evaluate as EV
from featurewatch.ml import zoo as Z
from featurewatch.ml.discriminant import fit_discriminant, long_array, long_features
from featurewatch.ml.expressions import compile_model, linear_model
from featurewatch.ml.score import score_batch, with_probability

NAMES = ["a", "b c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)).round(3)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) * .7 > 0).astype(int)
    data = [(i, int(y[i]), *(None if rng.random() < .05 else float("nan") if rng.random() < .03 else float(v) for v in x[i])) for i in range(400)]
    return spark.createDataFrame(data, "id long, label int, a double, `b c` double, d double").cache()


@pytest.fixture(scope="module")
def vectors(rows):
    return rows.select("id", "label", array_to_vector(F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`"), F.lit(0.0)), F.lit(0.0)) for c in NAMES])).alias("features"))


@pytest.mark.parametrize("model_type", ["logistic_regression", "svm", "xgboost", "lightgbm"])
@pytest.mark.parametrize("vector", [False, True])
def test_probabilities_equal_transform(rows, vectors, model_type, vector):
    df = vectors if vector else rows
    params = {"n_estimators": 8} if model_type in Z.TREE_TYPES else None
    model = Z.create_estimator(model_type, NAMES, params=params, vector_col="features" if vector else None, n_rows=400).fit(df)
    compiled = compile_model(model, NAMES if vector else None)
    assert compiled.names == NAMES
    want = {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    out = with_probability(model, df)
    got = {r["id"]: r["__p"] for r in out.select("id", "__p").collect()}
    assert len(got) == 400 and max(abs(got[i] - p) for i, p in want.items()) < 1e-12
    plan = out.select("__p")._jdf.queryExecution().executedPlan().toString()
    assert vector or "UDF" not in plan


def test_a_model_as_a_table_and_back(spark, rows):
    model = Z.create_estimator("logistic_regression", NAMES, n_rows=400).fit(rows)
    compiled = compile_model(model)
    table = compiled.table(spark)
    again = linear_model(compiled.names, compiled.inputs, table)
    assert table.count() == 4 and again.coefficients == compiled.coefficients and again.intercept == compiled.intercept
    trees = compile_model(Z.create_estimator("xgboost", NAMES, params={"n_estimators": 3, "max_depth": 2}).fit(rows)).table(spark)
    assert trees.select("tree").distinct().count() == 3 and trees.filter("feature is null").count() == trees.filter("value is not null").count()


def test_a_model_without_an_expression_is_transformed(spark, vectors):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    shifted = vectors.select("id", "label", array_to_vector(F.transform(vector_to_array("features"), lambda v: F.abs(v))).alias("features"))
    model = Pipeline(stages=[NaiveBayes(featuresCol="features", labelCol="label")]).fit(shifted)
    with pytest.raises(ValueError, match="NaiveBayes"):
        compile_model(model)
    assert score_batch(model, shifted, "nb", keep=["id"]).filter("probability is not null").count() == 400
    assert EV.importances(model, shifted, NAMES) == [(n, 1 / 3) for n in sorted(NAMES)]


def brute_permutation(model, df, repeats=5, seed=42):
    """Shuffles one column after the other and scores with ``transform``."""
    data = sorted((r.id, r.label, r.x) for r in df.select("id", "label", vector_to_array("features").alias("x")).collect())
    spark = df.sparkSession

    def accuracy(xs):
        new = spark.createDataFrame([(i, y, x) for (i, y, _), x in zip(data, xs, strict=True)], "id long, label int, x array<double>")
        sc = EV.scored(model, new.withColumn("features", array_to_vector("x")))
        return sc.filter("yhat = label").count() / len(data)

    base = accuracy([x for _, _, x in data])
    out = [0.0] * 3
    for r in range(repeats):
        hashes = {h.id: h.h for h in df.select("id", F.xxhash64("id", F.lit(seed + r)).alias("h")).collect()}
        donors = [x for _, _, x in sorted(data, key=lambda t: (hashes[t[0]], t[0]))]
        for j in range(3):
            out[j] += base - accuracy([[*x[:j], d[j], *x[j + 1:]] for (_, _, x), d in zip(data, donors, strict=True)])
    return [round(v / repeats, 6) for v in out]


@pytest.mark.parametrize("model_type", ["logistic_regression", "xgboost"])
def test_permutation_importance_equals_brute_force(vectors, model_type):
    params = {"n_estimators": 5} if model_type == "xgboost" else None
    model = Z.create_estimator(model_type, vector_col="features", params=params, n_rows=400).fit(vectors)
    got = {r.feature: r.importance for r in EV.importance_permutation(model, vectors, NAMES, repeats=2).collect()}
    want = brute_permutation(model, vectors, repeats=2)
    assert [got[n] for n in NAMES] == pytest.approx(want, abs=2e-6) and max(want) > 0.01


def test_importance_order_native_then_permutation(spark, rows, vectors, tmp_path):
    trees = Z.create_estimator("xgboost", vector_col="features", params={"n_estimators": 5}).fit(vectors)
    native = EV.importances(trees, vectors, NAMES)
    assert native == EV.importance_native(trees, NAMES) and sum(v for _, v in native) == pytest.approx(1)
    trees.stages[-1].write().save(str(tmp_path / "m"))
    stored = {r.feature: r.importance for r in EV.importance_of_nodes(spark.read.parquet(str(tmp_path / "m/data")), NAMES).collect()}
    assert stored == pytest.approx(dict(native), abs=1e-9)
    svm = Z.create_estimator("svm", NAMES, n_rows=400).fit(rows)
    assert EV.importance_native(svm, NAMES) is None
    pairs = EV.importances(svm, rows, NAMES)
    assert pairs[0][0] == "a" and pairs[0][1] > pairs[-1][1]          # by permutation, not uniform


def test_discriminant_is_one_pass_and_equals_numpy(spark, rows):
    df = rows.select("id", "label", *[F.col(f"`{c}`") for c in NAMES], F.lit(7.0).alias("flat"))
    table = {r.feature: r.coefficient for r in fit_discriminant(long_features(df, [*NAMES, "flat"], "label"), df, "label").collect()}
    data = df.toPandas()
    constant = math.log((data.label == 1).sum() / (data.label == 0).sum())
    for c in NAMES:
        x = data[[c, "label"]].dropna()
        a, b = x[x.label == 0][c], x[x.label == 1][c]
        v = (len(a) * a.var(ddof=0) + len(b) * b.var(ddof=0)) / len(x)
        assert table[c] == pytest.approx((b.mean() - a.mean()) / v)
        constant += (a.mean() ** 2 - b.mean() ** 2) / (2 * v)
    assert table["flat"] == 0.0 and table["(intercept)"] == pytest.approx(constant)
    arrays = df.select("label", F.array(*[F.col(f"`{c}`") for c in NAMES]).alias("x"))
    again = {r.feature: r.coefficient for r in fit_discriminant(long_array(arrays, "x", NAMES, "label"), arrays, "label").collect()}
    assert {c: again[c] for c in NAMES} == pytest.approx({c: table[c] for c in NAMES})
    model = linear_model(NAMES, [F.coalesce(F.nanvl(F.col(f"`{c}`"), F.lit(0.0)), F.lit(0.0)) for c in NAMES], spark.createDataFrame(list(table.items()), "feature string, coefficient double"))
    out = score_batch(model, df.withColumnRenamed("label", "y"), "m", keep=["id", "y"], top_factors=model.importances())
    assert out.filter("prediction = y").count() > 280 and out.first().top_factors[0].feature == "a"
    assert fit_discriminant(long_features(df.limit(0), NAMES, "label"), df.limit(0), "label").count() == 1


def test_exact_medians_are_learned_from_training_rows_and_saved(spark, rows, tmp_path):
    from pyspark.ml import PipelineModel

    from featurewatch.ml.median import ExactMedianImputerModel
    train = rows.filter("id % 2 = 0")
    model = Z.create_estimator("logistic_regression", NAMES, n_rows=200).fit(train)
    data = train.toPandas()
    want = [data[c].median() for c in NAMES]
    assert model.stages[0].getMedians() == pytest.approx(want, abs=1e-12)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(again.stages[0], ExactMedianImputerModel) and again.stages[0].getMedians() == model.stages[0].getMedians()
    a, b = ({r["id"]: r["__p"] for r in with_probability(m, rows).collect()} for m in (model, again))
    assert a == b and all(0 < p < 1 for p in a.values())
