"""Classification, split and concept-drift queries on ``labels``
(prediction = quality, outcome = toxic, logging order = doc_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurewatch.ml import split as SP
from featurewatch.operators import classify as C
from featurewatch.operators import concept as CD
from featurewatch.sources.tables import load

Q, SQL = {}, {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _labels(spark, d):
    return load(spark, d, "labels")


@q("class_balance")
def class_balance(spark, d):
    return C.class_balance(_labels(spark, d), "toxic")


SQL["class_balance"] = """
SELECT toxic, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM labels), 4) AS percent
FROM labels GROUP BY toxic"""

_COUNTS = """count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS tn, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS fp,
  count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fn, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp,
  count(*) AS n"""


@q("confusion_matrix")
def confusion_matrix(spark, d):
    return C.confusion_counts(_labels(spark, d), "toxic", "quality")


SQL["confusion_matrix"] = f"SELECT {_COUNTS} FROM labels"

_METRICS = """
  CASE WHEN n > 0 THEN CAST(tp + tn AS DOUBLE) / n ELSE 0.0 END AS acc,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS prec,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS rec"""


@q("classification_metrics")
def classification_metrics(spark, d):
    return C.classification_metrics(_labels(spark, d), "toxic", "quality")


SQL["classification_metrics"] = f"""WITH c AS (SELECT {_COUNTS} FROM labels), m AS (SELECT {_METRICS} FROM c)
SELECT round(acc, 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall,
  round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1_score FROM m"""


@q("auc_roc")
def auc_roc(spark, d):
    lab = _labels(spark, d)
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    return C.auc_roc(lab.join(docs, "doc_id"), "quality", "n_chars")


SQL["auc_roc"] = """WITH j AS (SELECT d.n_chars AS s, l.quality AS y FROM labels l JOIN documents d USING (doc_id)
                   WHERE d.n_chars IS NOT NULL AND l.quality IS NOT NULL),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM j),
a AS (SELECT sum(ar) FILTER (WHERE y = 1) AS rp, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS P,
             CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS N FROM r)
SELECT round(CASE WHEN P > 0 AND N > 0 THEN (rp - P * (P + 1) / 2) / (P * N) ELSE 0.0 END, 6) AS auc_roc,
  CAST(P AS BIGINT) AS n_positive, CAST(N AS BIGINT) AS n_negative FROM a"""


@q("classification_report")
def classification_report(spark, d):
    return C.classification_report(_labels(spark, d), "toxic", "quality")


SQL["classification_report"] = f"""WITH c AS (SELECT {_COUNTS} FROM labels),
k AS (
  SELECT CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS p1,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS r1,
         CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0.0 END AS p0,
         CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0.0 END AS r0,
         CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0 FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
                CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0 FROM k),
rows AS (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                   (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
  CAST(support AS BIGINT) AS support FROM rows"""

_RANKED = """h AS (SELECT *, md5(concat(CAST(doc_id AS VARCHAR), '-42')) AS ht FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY ht) AS rn, count(*) OVER (PARTITION BY toxic) AS cnt FROM h)"""


@q("stratified_split")
def stratified_split(spark, d):
    return SP.stratified_split(_labels(spark, d), "doc_id", "toxic")


SQL["stratified_split"] = f"""WITH {_RANKED}
SELECT doc_id, quality, toxic,
  CASE WHEN (CASE WHEN cnt > 1 THEN (rn - 1) / (cnt - 1) ELSE 0.0 END) < 0.8 THEN 'train' ELSE 'test' END AS split
FROM r"""


@q("stratified_folds")
def stratified_folds(spark, d):
    return SP.stratified_folds(_labels(spark, d), "doc_id", "toxic")


SQL["stratified_folds"] = f"""WITH {_RANKED}
SELECT doc_id, quality, toxic, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM r"""


@q("class_weights")
def class_weights(spark, d):
    return SP.class_weights(_labels(spark, d), "toxic")


SQL["class_weights"] = """WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic = 0) AS neg FROM labels)
SELECT 0 AS toxic, neg AS count, 1.0::DOUBLE AS weight FROM c
UNION ALL SELECT 1, pos, CASE WHEN pos > 0 THEN CAST(neg AS DOUBLE) / pos ELSE 1.0 END FROM c"""


@q("class_weights_balanced")
def class_weights_balanced(spark, d):
    return SP.class_weights_balanced(_labels(spark, d), "toxic")


SQL["class_weights_balanced"] = """
SELECT toxic, count(*) AS count,
  CAST((SELECT count(*) FROM labels) AS DOUBLE) / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)) AS weight
FROM labels GROUP BY toxic"""


@q("fold_summary")
def fold_summary(spark, d):
    folds = SP.stratified_folds(_labels(spark, d), "doc_id", "toxic")
    m = C.metrics_from_counts(C.confusion_counts(folds, "toxic", "quality", ["fold"]), ["fold"], digits=None)
    long = m.unpivot(["fold"], ["accuracy", "precision", "recall", "f1_score"], "metric", "value")
    return C.fold_summary(long).drop("folds")


SQL["fold_summary"] = f"""WITH {_RANKED},
f AS (SELECT *, (rn - 1) % 5 AS fold FROM r),
c AS (SELECT fold, {_COUNTS} FROM f GROUP BY fold),
m AS (SELECT fold, {_METRICS} FROM c),
m2 AS (SELECT fold, acc, prec, rec, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m),
long AS (SELECT 'accuracy' AS metric, fold, acc AS value FROM m2 UNION ALL SELECT 'precision', fold, prec FROM m2
         UNION ALL SELECT 'recall', fold, rec FROM m2 UNION ALL SELECT 'f1_score', fold, f1 FROM m2)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds
FROM long GROUP BY metric"""

_WINDOWS = """r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM labels),
g AS (SELECT CAST(floor((rn - 1) / 20) AS BIGINT) AS window_index, count(*) AS n,
        count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS fp,
        count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fn, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS tn,
        arg_min(doc_id, rn) AS start_time, arg_max(doc_id, rn) AS end_time
      FROM r GROUP BY 1 HAVING count(*) >= 5),
k AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS prec,
                CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS rec FROM g),
w AS (SELECT 'W' || CAST(window_index + 1 AS VARCHAR) AS label, window_index, n, tp, fp, fn, tn,
        round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END, 4) AS f1,
        round(rec, 4) AS recall, round(prec, 4) AS precision, round(CAST(tp + tn AS DOUBLE) / n, 4) AS accuracy,
        start_time, end_time FROM k)"""


def _windows(spark, d):
    return CD.concept_windows(_labels(spark, d), "doc_id", "toxic", "quality")


@q("concept_windows")
def concept_windows(spark, d):
    return _windows(spark, d)


SQL["concept_windows"] = f"WITH {_WINDOWS} SELECT * FROM w"


@q("concept_verdict")
def concept_verdict(spark, d):
    return CD.concept_verdict(_windows(spark, d), _labels(spark, d))


SQL["concept_verdict"] = f"""WITH {_WINDOWS},
a AS (SELECT count(*) AS n_windows, arg_max(f1, window_index) AS latest_f1, sum(f1) AS s FROM w),
b AS (SELECT n_windows, latest_f1,
        CASE WHEN n_windows >= 2 THEN (s - latest_f1) / (n_windows - 1) ELSE latest_f1 END AS baseline_f1 FROM a),
c AS (SELECT *, latest_f1 - baseline_f1 AS delta FROM b)
SELECT CASE WHEN n_windows = 0 THEN (CASE WHEN (SELECT count(*) FROM labels) = 0 THEN 'NO_DATA' ELSE 'INSUFFICIENT_DATA' END)
            WHEN delta > -0.05 THEN 'OK' WHEN delta > -0.10 THEN 'WARNING' ELSE 'DRIFT_DETECTED' END AS status,
  (SELECT count(*) FROM labels) AS confirmed_count, n_windows,
  round(latest_f1, 4) AS latest_f1, round(baseline_f1, 4) AS baseline_f1, round(delta, 4) AS f1_delta,
  CASE WHEN delta > -0.05 THEN NULL
       WHEN delta > -0.10 THEN 'WARNING: F1 fell by ' || printf('%.1f', abs(delta) * 100) || ' points'
       ELSE 'DRIFT_DETECTED: F1 fell by ' || printf('%.1f', abs(delta) * 100) || ' points'
  END AS alert_message
FROM c"""


@q("reference_sample")
def reference_sample(spark, d):
    return SP.reference_sample(load(spark, d, "orders"), "o_orderkey", n=1000)


SQL["reference_sample"] = """
SELECT * FROM orders ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-42')) LIMIT 1000"""
