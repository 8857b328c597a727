"""Drift statistics, running sums, classification metrics and log statistics,
each checked against a direct numpy re-statement of the formula."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from featurewatch.operators import classify as C
from featurewatch.operators import drift as D
from featurewatch.operators import log_stats as LS
from featurewatch.operators.ordering import global_row_number, running_sums


def _long(spark, ref, prod, feature="x"):
    rows = [(feature, D.REF, float(v)) for v in ref] + [(feature, D.PROD, float(v)) for v in prod]
    return spark.createDataFrame(rows, "feature string, side string, value double")


def np_psi(ref, prod, bins=10):
    edges = np.linspace(min(ref.min(), prod.min()), max(ref.max(), prod.max()), bins + 1)
    r = np.histogram(ref, bins=edges)[0] / len(ref) + 1e-6
    p = np.histogram(prod, bins=edges)[0] / len(prod) + 1e-6
    return float(np.sum((p - r) * np.log(p / r))), r, p


def np_ks(a, b):
    xs = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), xs, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), xs, side="right") / len(b)
    return float(np.max(np.abs(fa - fb)))


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(42)
    return rng.normal(5, 1, 1000).round(3), rng.normal(10, 2, 1000).round(3), rng.normal(5, 1, 50).round(3)


def test_psi_same_is_zero(spark, samples):
    ref = samples[0]
    out = D.psi(_long(spark, ref, ref)).first()
    assert out.psi == pytest.approx(0.0, abs=1e-9) and out.psi_status == "OK"


def test_psi_kl_ks_match_numpy(spark, samples):
    ref, prod = samples[0], samples[1]
    long = _long(spark, ref, prod)
    rep = D.drift_report(long, buckets=4).first()
    psi, r, p = np_psi(ref, prod)
    assert rep.psi == pytest.approx(round(psi, 6), abs=1e-6) and rep.psi > 0.1
    rn, pn = r / r.sum(), p / p.sum()
    assert rep.kl_divergence == pytest.approx(round(float(np.sum(pn * np.log(pn / rn))), 6), abs=1e-6)
    assert rep.ks_statistic == pytest.approx(np_ks(ref, prod), abs=1e-6)
    shift = abs(prod.mean() - ref.mean()) / ref.std()
    assert rep.mean_shift == pytest.approx(shift, abs=1e-5)
    assert rep.drift_status == "DRIFT_DETECTED"


def test_histogram_bin_edges_like_numpy(spark):
    ref = np.array([0.0, 0.1, 0.3, 0.7, 1.0, 0.3])
    prod = np.array([0.05, 0.3, 0.7, 0.7, 0.99])
    h = D.histogram_pair(_long(spark, ref, prod)).orderBy("bin").collect()
    edges = np.linspace(0, 1, 11)
    assert [r.ref_count for r in h] == list(np.histogram(ref, bins=edges)[0])
    assert [r.prod_count for r in h] == list(np.histogram(prod, bins=edges)[0])


def test_constant_column_and_too_few_values(spark):
    long = _long(spark, [3.0] * 10, [3.0] * 6).unionByName(_long(spark, [1.0, 2.0, 3.0], [1.0], "few"))
    rep = {r.feature: r for r in D.drift_report(long).collect()}
    assert rep["x"].psi == 0.0 and rep["x"].drift_status == "OK" and rep["x"].mean_shift == 0.0
    assert "few" not in rep
    el = {r.feature: r.status for r in D.drift_eligibility(
        long.unionByName(spark.createDataFrame([("new", D.PROD, 1.0)], long.schema))).collect()}
    assert el == {"x": "READY", "few": "INSUFFICIENT", "new": "UNKNOWN"}


def test_ks_pvalue_series(spark):
    df = spark.createDataFrame([(1.0, 100, 100), (0.0, 10, 10), (0.3, 50, 50)], "d double, a long, b long")
    lam = np.array([1.0 * np.sqrt(50), 0.0, 0.3 * 5])
    out = [r[0] for r in df.select(D.kolmogorov_pvalue(F.col("d"), F.col("a"), F.col("b"))).collect()]
    k = np.arange(1, 101)
    exp = [min(1.0, max(0.0, float(np.sum(2 * (-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x))))) if x >= 0.3 else 1.0
           for x in lam]
    assert out == pytest.approx(exp)


def test_running_sums_equal_global_window(spark):
    rows = [(g, float(v), 1) for g in ("a", "b") for v in np.random.default_rng(1).integers(0, 40, 300)]
    rows += [("a", 7.0, 1)] * 200            # a hot value
    df = spark.createDataFrame(rows, "g string, x double, c int")
    got = running_sums(df, ["g"], ["x"], {"cum": F.col("c")}, buckets=5)
    w = Window.partitionBy("g").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    exp = df.withColumn("cum", F.sum("c").over(w))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_global_row_number_unique_and_dense(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    rn = global_row_number(df, ["k"], name="rn", buckets=7)
    r = rn.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).first()
    assert tuple(r) == (1, 1000, 1000)
    first = rn.filter("rn = 1").first().k
    assert first == df.agg(F.min("k")).first()[0]


def test_classification_metrics_reference_cases(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 0, 1], [0, 0, 1, 0, 0, 1])), "y int, p int")
    m = C.classification_metrics(df, "y", "p").first()
    assert (m.accuracy, m.precision, m.recall, m.f1_score) == (round(5 / 6, 6), 1.0, round(2 / 3, 6), 0.8)
    cm = C.confusion_counts(spark.createDataFrame(list(zip([0, 0, 1, 1], [0, 1, 1, 0])), "y int, p int"),
                            "y", "p").first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (1, 1, 1, 1)
    none = C.classification_metrics(spark.createDataFrame([(1, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert none.precision == 0.0 and none.f1_score == 0.0


def test_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    assert C.auc_roc(df, "y", "s").first().auc_roc == 1.0
    ties = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.1), (1, 0.9)], "y int, s double")
    assert C.auc_roc(ties, "y", "s", buckets=3).first().auc_roc == pytest.approx(0.875)
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert C.auc_roc(one, "y", "s").first().auc_roc == 0.0


def test_classification_report_macro_weighted(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 0, 1], [0, 0, 1, 0, 0, 1])), "y int, p int")
    rep = {r["class"]: r for r in C.classification_report(df, "y", "p").collect()}
    assert rep["1"].recall == pytest.approx(2 / 3, abs=1e-6) and rep["0"].precision == pytest.approx(0.75)
    assert rep["macro avg"].f1_score == pytest.approx((0.8 + 6 / 7) / 2, abs=1e-6)
    assert rep["weighted avg"].support == 6


def _log(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(str(i), i, base + dt.timedelta(minutes=m), p, pr, lat) for i, (m, p, pr, lat) in enumerate(rows)]
    df = spark.createDataFrame(data, "prediction_id string, seq long, timestamp timestamp_ntz, prediction int, "
                                     "probability double, latency_ms double")
    return df.withColumn("features", F.create_map(F.lit("a"), F.lit("1")))


def test_prediction_stats_empty_and_two_rows(spark):
    empty = _log(spark, [(0, 1, 0.5, 1.0)]).limit(0)
    s = LS.prediction_stats(empty).first()
    assert s.total_predictions == 0 and s.risk_rate == 0.0 and s.avg_probability == 0.0
    two = LS.prediction_stats(_log(spark, [(0, 1, 0.9, 1.0), (1, 0, 0.1, None)])).first()
    assert two.risk_rate == 0.5 and two.std_probability == pytest.approx(0.4)


def test_latency_percentiles_numpy(spark):
    lats = list(np.random.default_rng(7).uniform(0, 500, 333).round(2))
    log = _log(spark, [(i, 0, 0.1, float(v)) for i, v in enumerate(lats)] + [(999, 0, 0.1, None)])
    r = LS.latency_percentiles(log, buckets=5).first()
    assert r["count"] == 333
    for name, q in (("p50_ms", 50), ("p95_ms", 95), ("p99_ms", 99)):
        assert r[name] == pytest.approx(round(float(np.percentile(lats, q)), 2), abs=0.011)


def test_throughput_and_retention(spark):
    log = _log(spark, [(m, 0, 0.1, 1.0) for m in (0, 10, 50, 100, 120)])
    t = LS.throughput(log, 60).first()
    assert t.requests_in_window == 2 and t.avg_per_minute == 0.03   # minutes 100 and 120 are >= 120 - 60
    kept = LS.log_retention(log, max_rows=2).orderBy("seq").collect()
    assert [r.seq for r in kept] == [3, 4]


def test_one_sided_features_do_not_fail(spark, samples):
    ref, prod = samples[0], samples[2]
    long = (_long(spark, ref, prod).unionByName(_long(spark, [], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "prod_only"))
            .unionByName(_long(spark, [1.0, 2.0], [], "ref_only")))
    rep = {r.feature for r in D.drift_report(long).collect()}
    assert rep == {"x"}
    assert {r.feature for r in D.psi(long).collect()} >= {"x"}
    assert D.ks_statistic(long).filter("feature = 'x'").first().ks_statistic > 0


def test_exact_pvalue_matches_all_arrangements():
    from itertools import combinations
    for n1, n2 in ((3, 4), (5, 5), (4, 7)):
        stats = []
        for own in combinations(range(n1 + n2), n1):
            i = j = best = 0
            for k in range(n1 + n2):
                i, j = (i + 1, j) if k in own else (i, j + 1)
                best = max(best, abs(i * n2 - j * n1))
            stats.append(best)
        for h in sorted(set(stats)):
            assert D.exact_pvalue(h, n1, n2) == pytest.approx(sum(s >= h for s in stats) / len(stats))


def test_one_sided_features_and_overall_states(spark):
    rows = [("a", "reference", float(i)) for i in range(20)] + [("a", "production", float(i)) for i in range(20)] + [("only", "production", 1.0)] * 9
    long = spark.createDataFrame(rows, "feature string, side string, value double")
    psi = {r.feature: (r.psi, r.psi_status) for r in D.psi(long).collect()}
    assert psi["only"] == (0.0, "OK")
    assert {r.feature: r.kl_divergence for r in D.kl_divergence(long).collect()}["only"] == 0.0
    rep = D.drift_report(long).collect()
    assert [(r.feature, r.drift_status, r.ks_pvalue) for r in rep] == [("a", "OK", 1.0)]
    prod, ref = long.filter("side = 'production'"), long.filter("side = 'reference'")
    status = lambda *x: D.drift_overview(*x).first().status
    assert status(prod, ref) == "OK" and status(prod.limit(0), ref) == "NO_DATA"
    assert status(prod.filter("feature = 'only'"), ref) == "OK"          # rows, but none to check
    assert status(prod, None) == "NO_REFERENCE" and status(prod, ref.select("feature")) == "ERROR"
