"""Training, search, evaluation, importance, storage and scoring queries
(M1-M16, S12-S15, O1, O2, O4).  Iterative fits are not SQL-expressible, so
their keys are rows-only checks; scoring uses a model whose coefficients SQL
can derive, and ``scoring_agrees`` holds scoring by expressions to ``transform``.

Data: ``embeddings`` — 64 float features, binary target ``label >= 5``,
key ``vec_id``.  Store-backed scoring uses the customer feature views.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featurewatch.ml import evaluate as EV
from featurewatch.ml import zoo as Z
from featurewatch.ml.discriminant import fit_discriminant, long_array, long_features
from featurewatch.ml.expressions import compile_model, linear_model
from featurewatch.ml.median import ExactMedianImputer
from featurewatch.ml.score import score_batch as _score_batch
from featurewatch.ml.score import with_probability
from featurewatch.ml.split import stratified_split, weighted
from featurewatch.ml.train import fit_weighted, run_training
from featurewatch.operators import classify as C
from featurewatch.operators.asof import online_lookup
from featurewatch.session import storage_path
from featurewatch.sources import feature_store as FS
from featurewatch.sources.tables import load

Q, SQL = {}, {}
DIM = 64
NAMES = [f"e{i}" for i in range(DIM)]


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def training_frame(spark, d):
    e = load(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), array_to_vector("embedding").alias("features"),
                    (F.col("label") >= 5).cast("int").alias("label"))


def _split(spark, d):
    s = stratified_split(training_frame(spark, d), "id", "label")
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")


def _evaluate(spark, d, model_type, params=None):
    train, test = _split(spark, d)
    model, *_ = fit_weighted(train, model_type, "label", "id", vector_col="features", params=params)
    return EV.metrics(EV.scored(model, test)).select(F.lit(model_type).alias("model_type"), "*")


@q("train_gbt")
def train_gbt(spark, d):
    return _evaluate(spark, d, "xgboost")


@q("train_catboost")
def train_catboost(spark, d):
    return _evaluate(spark, d, "catboost")


@q("train_lightgbm")
def train_lightgbm(spark, d):
    return _evaluate(spark, d, "lightgbm")


@q("train_logistic")
def train_logistic(spark, d):
    return _evaluate(spark, d, "logistic_regression")


@q("train_logistic_l1")
def train_logistic_l1(spark, d):
    return _evaluate(spark, d, "logistic_regression", {"penalty": "l1"})


@q("train_linear_svc")
def train_linear_svc(spark, d):
    return _evaluate(spark, d, "svm")


@q("training_rows")
def training_rows(spark, d):
    """What the models train and are tested on: rows, classes and the weights of each model type."""
    train, test = _split(spark, d)
    parts = []
    for model_type in Z.MODEL_TYPES:
        for name, rows in (("train", weighted(train, "label", model_type)), ("test", test.withColumn("weight", F.lit(1.0)))):
            parts.append(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight")).select(
                F.lit(model_type).alias("model_type"), F.lit(name).alias("split"), "label", "n", "weight"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SQL["training_rows"] = """WITH t AS (SELECT vec_id AS id, CAST(label >= 5 AS INTEGER) AS label FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '-42')) AS rn, count(*) OVER (PARTITION BY label) AS c FROM t),
s AS (SELECT label, CASE WHEN (CASE WHEN c > 1 THEN CAST(rn - 1 AS DOUBLE) / (c - 1) ELSE 0.0 END) < 0.8 THEN 'train' ELSE 'test' END AS split FROM r),
g AS (SELECT split, label, count(*) AS n FROM s GROUP BY 1, 2),
x AS (SELECT (SELECT n FROM g WHERE split = 'train' AND label = 0) AS neg, (SELECT n FROM g WHERE split = 'train' AND label = 1) AS pos)
SELECT m.model_type, g.split, g.label, g.n, round(g.n * CASE WHEN g.split = 'test' THEN 1.0
  WHEN m.model_type IN ('logistic_regression', 'svm') THEN CAST(x.neg + x.pos AS DOUBLE) / (2 * g.n)
  WHEN g.label = 1 THEN CAST(x.neg AS DOUBLE) / x.pos ELSE 1.0 END, 6) AS weight
FROM g, x, (VALUES ('xgboost'), ('catboost'), ('lightgbm'), ('logistic_regression'), ('svm')) m(model_type)"""


@q("random_search")
def random_search(spark, d):
    train, test = _split(spark, d)
    best, table, *_ = fit_weighted(train, "logistic_regression", "label", "id", vector_col="features", optimize=True)
    best_f1 = C.classification_metrics(EV.scored(best, test), "label", "yhat").select("f1_score").scalar()
    return table.withColumn("best_test_f1", best_f1)


def _weighted_logistic(spark, d):
    rows = weighted(training_frame(spark, d), "label", "logistic_regression")
    n = rows.count()
    return rows, lambda: Z.create_estimator("logistic_regression", vector_col="features", weight_col="weight", n_rows=n)


@q("cross_validate")
def cross_validate(spark, d):
    return C.fold_summary(EV.cross_validate(*_weighted_logistic(spark, d), key="id"))


@q("learning_curve")
def learning_curve(spark, d):
    return EV.learning_curve(*_weighted_logistic(spark, d), key="id")


@q("importance_permutation")
def importance_permutation(spark, d):
    train, test = _split(spark, d)
    model, *_ = fit_weighted(train, "logistic_regression", "label", "id", vector_col="features")
    return EV.importance_permutation(model, test, NAMES, key="id")


@q("importance_native")
def importance_native(spark, d):
    """M12's first choice, computed from the stored trees of a boosted model."""
    train, _ = _split(spark, d)
    model, *_ = fit_weighted(train, "xgboost", "label", "id", vector_col="features", params={"n_estimators": 20})
    path = storage_path(spark, "models", f"importance_{uuid.uuid4().hex[:8]}")
    model.stages[-1].write().save(path)
    return EV.importance_of_nodes(spark.read.parquet(f"{path}/data"), NAMES).select("feature", F.round("importance", 6).alias("importance"))


def _discriminant(spark, d):
    """A linear model of ``embeddings`` whose coefficients are aggregates of the training rows."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") >= 5).cast("int").alias("label"))
    train = stratified_split(e, "id", "label").filter("split = 'train'")
    table = fit_discriminant(long_array(train, "embedding", NAMES, "label"), train, "label")
    inputs = [F.get("embedding", F.lit(i)).cast("double") for i in range(DIM)]
    return e, linear_model(NAMES, inputs, table)


_COEFFICIENTS = """t AS (SELECT vec_id AS id, embedding, CAST(label >= 5 AS INTEGER) AS y FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '-42')) AS rn, count(*) OVER (PARTITION BY y) AS c FROM t),
tr AS (SELECT * FROM r WHERE (CASE WHEN c > 1 THEN CAST(rn - 1 AS DOUBLE) / (c - 1) ELSE 0.0 END) < 0.8),
lng AS (SELECT 'e' || (i - 1) AS feature, y, CAST(embedding[i] AS DOUBLE) AS x FROM tr, range(1, 65) g(i)),
st AS (SELECT feature, avg(x) FILTER (WHERE y = 0) AS m0, avg(x) FILTER (WHERE y = 1) AS m1,
  (count(*) FILTER (WHERE y = 0) * var_pop(x) FILTER (WHERE y = 0) + count(*) FILTER (WHERE y = 1) * var_pop(x) FILTER (WHERE y = 1)) / count(*) AS v
  FROM lng GROUP BY feature),
co AS (SELECT feature, (m1 - m0) / v AS coefficient, (m0 * m0 - m1 * m1) / (2 * v) AS k FROM st),
ic AS (SELECT sum(k) + (SELECT ln(CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) / count(*) FILTER (WHERE y = 0)) FROM tr) AS b FROM co)"""


@q("model_coefficients")
def model_coefficients(spark, d):
    """The linear model as a table: a row per coefficient."""
    _, model = _discriminant(spark, d)
    return model.table(spark).select("feature", F.round("coefficient", 6).alias("coefficient"))


SQL["model_coefficients"] = f"""WITH {_COEFFICIENTS}
SELECT feature, round(coefficient, 6) AS coefficient FROM co UNION ALL SELECT '(intercept)', round(b, 6) FROM ic"""


@q("scoring_agrees")
def scoring_agrees(spark, d):
    """Models of each kind, scored by expressions and by ``transform``: rows, and how many differ by more than 1e-12."""
    train, _ = _split(spark, d)
    parts = []
    for model_type, params in (("logistic_regression", None), ("svm", None), ("xgboost", {"n_estimators": 10})):
        model, *_ = fit_weighted(train, model_type, "label", "id", vector_col="features", params=params)
        both = with_probability(compile_model(model, NAMES), EV.scored(model, training_frame(spark, d)))
        parts.append(both.agg(F.lit(model_type).alias("model_type"), F.count(F.lit(1)).alias("n_rows"),
                              F.count_if(F.abs(F.col("__p") - F.col("p1")) > 1e-12).alias("n_different"),
                              F.count_if((F.col("__p") >= 0.5) != (F.col("yhat") == 1)).alias("n_other_class")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL["scoring_agrees"] = """SELECT m.model_type, count(*) AS n_rows, 0 AS n_different, 0 AS n_other_class
FROM embeddings, (VALUES ('logistic_regression'), ('svm'), ('xgboost')) m(model_type) GROUP BY 1"""


@q("imputer_medians")
def imputer_medians(spark, d):
    """E11 on the training path: the medians that the pipeline's first stage learns from the training rows alone."""
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                                        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"),
                                        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey").cast("double")).alias("customer"))
    train = stratified_split(o, "o_orderkey", "label").filter("split = 'train'")
    model = ExactMedianImputer(inputCols=["price", "customer"], outputCols=["p", "c"]).fit(train)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(m).alias("median")) for n, m in zip(model.getInputCols(), model.getMedians(), strict=True)])
    filled = model.transform(train).agg(F.count("p").alias("n_p"), F.count("c").alias("n_c"))
    return filled.select(F.inline(rows), "n_p", "n_c").select("feature", F.round("median", 6).alias("median"), F.when(F.col("feature") == "price", F.col("n_p")).otherwise(F.col("n_c")).alias("n_filled"))


SQL["imputer_medians"] = """WITH t AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS price,
  CASE WHEN o_custkey % 3 > 0 THEN CAST(o_custkey AS DOUBLE) END AS customer FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42')) AS rn, count(*) OVER (PARTITION BY y) AS c FROM t),
tr AS (SELECT * FROM r WHERE (CASE WHEN c > 1 THEN CAST(rn - 1 AS DOUBLE) / (c - 1) ELSE 0.0 END) < 0.8)
SELECT 'price' AS feature, round(quantile_cont(price, 0.5), 6) AS median, count(*) AS n_filled FROM tr
UNION ALL SELECT 'customer', round(quantile_cont(customer, 0.5), 6), count(*) FROM tr"""


TRAIN_FEATURES = ["priority_code", "had_status", "status_code", "priority_num", "is_urgent", "is_low", "years", "delta", "row_std"]


@q("pipeline_train")
def pipeline_train(spark, d):
    """Preprocess, derive features, select, split, weight, search, evaluate, cross-validate, save."""
    from featurewatch.plans.q_features import pipeline_features
    run = run_training(pipeline_features(spark, d), "o_orderkey", "target", TRAIN_FEATURES, "logistic_regression",
                       selected=[*TRAIN_FEATURES, "not_a_feature"])
    best = run.candidates.agg(F.max("mean_f1")).scalar()
    cv = run.cv.filter("metric = 'f1_score'").agg(F.avg("value")).scalar()
    return run.metrics.select(F.lit(run.model_type).alias("model_type"), F.lit(run.n_train).alias("n_training_samples"),
                              F.lit(run.n_test).alias("n_test_samples"), F.lit(len(run.features)).alias("feature_count"), "*",
                              best.alias("best_search_f1"), cv.alias("cv_f1"))


@q("score_batch")
def score_batch(spark, d):
    """M14 with J8: all rows scored by the model's expressions."""
    rows, model = _discriminant(spark, d)
    return _score_batch(model, rows, "embeddings_gda", keep=["id"], top_factors=model.importances()).withColumn(
        "top_factors", _factor_text())


def _factor_text():
    return F.array_join(F.transform("top_factors", lambda t: F.concat(t["feature"], F.lit("="), F.format_string("%.4f", t["importance"]))), ";")


_BANDS = """CASE WHEN p >= 0.8 THEN 'Muito Alto' WHEN p >= 0.6 THEN 'Alto' WHEN p >= 0.4 THEN 'Moderado' WHEN p >= 0.2 THEN 'Baixo'
  WHEN p IS NOT NULL THEN 'Muito Baixo' END"""


def _scored_sql(keep: str, model_id: str, factors: str) -> str:
    from featurewatch.functions.derive import LABEL_AT_RISK, LABEL_NOT_AT_RISK
    return f"""{keep}, CAST(p >= 0.5 AS INTEGER) AS prediction, round(p, 4) AS probability, {_BANDS} AS risk_level,
  CASE WHEN p >= 0.5 THEN '{LABEL_AT_RISK}' WHEN p IS NOT NULL THEN '{LABEL_NOT_AT_RISK}' END AS label, {factors} AS top_factors, '{model_id}' AS model_id"""


SQL["score_batch"] = f"""WITH {_COEFFICIENTS},
m AS (SELECT t.id, sum(CAST(t.embedding[CAST(substr(co.feature, 2) AS INTEGER) + 1] AS DOUBLE) * co.coefficient) + (SELECT b FROM ic) AS margin
  FROM t, co GROUP BY t.id),
s AS (SELECT id, 1 - 1 / (1 + exp(margin)) AS p FROM m),
f AS (SELECT string_agg(feature || '=' || printf('%.4f', share), ';' ORDER BY share DESC, feature) AS factors FROM (
  SELECT feature, abs(coefficient) / sum(abs(coefficient)) OVER () AS share FROM co ORDER BY share DESC, feature LIMIT 5))
SELECT {_scored_sql("id", "embeddings_gda", "f.factors")} FROM s, f"""


# ---------------------------------------------------------------- M15

def _store_frame(spark, d):
    from featurewatch.plans.q_store import CUSTOMER_PROFILE, PROFILE_TIME, orders_value
    latest = FS.materialize(orders_value(spark, d), "cust_id", tiebreak="o_orderkey")
    prof = FS.ingest_view(load(spark, d, "customer"), CUSTOMER_PROFILE, "c_custkey", PROFILE_TIME)
    return latest.select("cust_id", "o_totalprice").join(prof.select("cust_id", "c_acctbal", "c_nationkey"),
                                                         "cust_id", "right")


STORE_FEATURES = ["o_totalprice", "c_acctbal", "c_nationkey"]


@q("score_from_store")
def score_from_store(spark, d):
    """Online lookup of ids in the store, then batch scoring; a missing value counts as the feature's mean, as in
    training rows that have none."""
    cust = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cust_id"),
                                             (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"))
    store = _store_frame(spark, d).select("cust_id", *[F.col(c).cast("double").alias(c) for c in STORE_FEATURES])
    train = store.join(cust, "cust_id")
    table = fit_discriminant(long_features(train, STORE_FEATURES, "label"), train, "label")
    means = train.agg(*[F.avg(c).alias(c) for c in STORE_FEATURES]).first()
    model = linear_model(STORE_FEATURES, [F.coalesce(F.col(c), F.lit(means[c])) for c in STORE_FEATURES], table)
    # one id is not in the store: it comes back with found = false and no score
    ids = cust.filter(F.col("label") == 1).select("cust_id").union(spark.range(1).select(F.lit("unknown")))
    found = online_lookup(ids, "cust_id", store)
    scored = _score_batch(model, found, "store_gda", keep=["cust_id", "found"], top_factors=model.importances()).withColumn("top_factors", _factor_text())
    empty = [F.when(F.col("found"), F.col(c)).alias(c) for c in scored.columns if c not in ("cust_id", "found")]
    return scored.select("cust_id", "found", *empty)


SQL["score_from_store"] = f"""WITH fv AS (SELECT CAST(o_custkey AS VARCHAR) AS cust_id, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
tr AS (SELECT CAST(c_custkey AS VARCHAR) AS cust_id, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
  CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer LEFT JOIN fv ON fv.cust_id = CAST(c_custkey AS VARCHAR)),
lng AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, y, {c} AS x FROM tr WHERE {c} IS NOT NULL" for c in STORE_FEATURES)}),
st AS (SELECT feature, avg(x) AS m, avg(x) FILTER (WHERE y = 0) AS m0, avg(x) FILTER (WHERE y = 1) AS m1,
  (count(*) FILTER (WHERE y = 0) * var_pop(x) FILTER (WHERE y = 0) + count(*) FILTER (WHERE y = 1) * var_pop(x) FILTER (WHERE y = 1)) / count(*) AS v
  FROM lng GROUP BY feature),
co AS (SELECT feature, m, (m1 - m0) / v AS coefficient, (m0 * m0 - m1 * m1) / (2 * v) AS k FROM st),
ic AS (SELECT sum(k) + (SELECT ln(CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) / count(*) FILTER (WHERE y = 0)) FROM tr) AS b FROM co),
s AS (SELECT cust_id, 1 - 1 / (1 + exp({" + ".join(f"coalesce({c}, (SELECT m FROM co WHERE feature = '{c}')) * (SELECT coefficient FROM co WHERE feature = '{c}')" for c in STORE_FEATURES)}
  + (SELECT b FROM ic))) AS p FROM tr WHERE y = 1),
f AS (SELECT string_agg(feature || '=' || printf('%.4f', share), ';' ORDER BY share DESC, feature) AS factors FROM (
  SELECT feature, abs(coefficient) / sum(abs(coefficient)) OVER () AS share FROM co))
SELECT {_scored_sql("cust_id, TRUE AS found", "store_gda", "f.factors")} FROM s, f
UNION ALL SELECT 'unknown', FALSE, NULL, NULL, NULL, NULL, NULL, NULL"""
