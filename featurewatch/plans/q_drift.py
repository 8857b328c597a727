"""Drift queries (H1-H10) on lineitem: reference = return flag 'A', production = 'R'."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featurewatch.operators import drift as D
from featurewatch.operators import drift_days as DD
from featurewatch.plans.roles import DRIFT_FEATURES, LOG_SQL, drift_long, drift_long_sql, prediction_log
from featurewatch.session import storage_path
from featurewatch.sources.tables import load

Q, SQL = {}, {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


#: The p-value of the oracle is the series for samples of more than 10,000 values, as they are from sf0.01 on.
_BASE = f"""WITH {drift_long_sql()},
clean AS (SELECT feature, side, value FROM long WHERE value IS NOT NULL AND NOT isnan(value)),
m AS (SELECT feature,
        count(*) FILTER (WHERE side = 'reference') AS n_ref,
        count(*) FILTER (WHERE side = 'production') AS n_prod,
        min(value) AS lo, max(value) AS hi,
        avg(value) FILTER (WHERE side = 'reference') AS ref_mean,
        avg(value) FILTER (WHERE side = 'production') AS prod_mean,
        stddev_pop(value) FILTER (WHERE side = 'reference') AS ref_std
      FROM clean GROUP BY feature),
e AS (SELECT *, list_transform(range(0, 11),
        lambda i: CASE WHEN i = 10 THEN hi ELSE CAST(i AS DOUBLE) * ((hi - lo) / 10.0) + lo END) AS edges FROM m),
hb AS (SELECT c.feature, c.side, least(10, len(list_filter(e.edges, lambda x: x <= c.value))) AS bin
       FROM clean c JOIN e USING (feature)),
hc AS (SELECT feature, bin, count(*) FILTER (WHERE side = 'reference') AS rc,
              count(*) FILTER (WHERE side = 'production') AS pc FROM hb GROUP BY feature, bin),
grid AS (SELECT e.feature, g.bin, e.n_ref, e.n_prod, e.edges FROM e CROSS JOIN range(1, 11) g(bin)),
hist AS (SELECT grid.feature, grid.bin, grid.edges[grid.bin] AS lower_edge, grid.edges[grid.bin + 1] AS upper_edge,
                coalesce(hc.rc, 0) AS ref_count, coalesce(hc.pc, 0) AS prod_count, grid.n_ref, grid.n_prod
         FROM grid LEFT JOIN hc USING (feature, bin)),
sh AS (SELECT feature, CAST(ref_count AS DOUBLE) / n_ref + 1e-6 AS r, CAST(prod_count AS DOUBLE) / n_prod + 1e-6 AS p FROM hist),
pk AS (SELECT feature, sum((p - r) * ln(p / r)) AS psi FROM sh GROUP BY feature),
shn AS (SELECT feature, p / sum(p) OVER (PARTITION BY feature) AS pn, r / sum(r) OVER (PARTITION BY feature) AS rn FROM sh),
kl AS (SELECT feature, sum(pn * ln(pn / rn)) AS kl FROM shn GROUP BY feature),
red AS (SELECT feature, value, count(*) FILTER (WHERE side = 'reference') AS nr,
               count(*) FILTER (WHERE side = 'production') AS np FROM clean GROUP BY feature, value),
cum AS (SELECT feature,
          CAST(sum(nr) OVER w AS DOUBLE) AS cr, CAST(sum(np) OVER w AS DOUBLE) AS cp,
          CAST(sum(nr) OVER (PARTITION BY feature) AS DOUBLE) AS tr, CAST(sum(np) OVER (PARTITION BY feature) AS DOUBLE) AS tp
        FROM red WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks0 AS (SELECT feature, max(abs(cr / tr - cp / tp)) AS d, any_value(tr) AS tr, any_value(tp) AS tp FROM cum GROUP BY feature),
ks AS (SELECT feature, d, tr, tp, d * sqrt(tr * tp / (tr + tp)) AS lam FROM ks0),
ksp AS (SELECT feature, d, CASE WHEN lam < 0.3 THEN 1.0 ELSE least(1.0, greatest(0.0,
          list_sum(list_transform(range(1, 101), lambda k: 2.0 * pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam))))) END AS pv
        FROM ks),
ms AS (SELECT feature, abs(prod_mean - ref_mean) / CASE WHEN ref_std > 1e-6 THEN ref_std ELSE 1.0 END AS shift FROM m)
"""


@q("histogram_pair")
def histogram_pair(spark, d):
    h = D.histogram_pair(drift_long(spark, d))
    return h.select("feature", "bin", F.round(F.col("lower_edge") + 0.0, 6).alias("lower_edge"),
                    F.round(F.col("upper_edge") + 0.0, 6).alias("upper_edge"), "ref_count", "prod_count",
                    F.round("ref_share", 8).alias("ref_share"), F.round("prod_share", 8).alias("prod_share"))


SQL["histogram_pair"] = _BASE + """
SELECT feature, CAST(bin AS INTEGER) AS bin, round(lower_edge + 0.0, 6) AS lower_edge, round(upper_edge + 0.0, 6) AS upper_edge,
       CAST(ref_count AS BIGINT) AS ref_count, CAST(prod_count AS BIGINT) AS prod_count,
       round(CAST(ref_count AS DOUBLE) / n_ref + 1e-6, 8) AS ref_share,
       round(CAST(prod_count AS DOUBLE) / n_prod + 1e-6, 8) AS prod_share
FROM hist"""


@q("psi")
def psi(spark, d):
    return D.psi(drift_long(spark, d))


SQL["psi"] = _BASE + """
SELECT feature, round(psi, 6) AS psi,
       CASE WHEN psi < 0.1 THEN 'OK' WHEN psi < 0.2 THEN 'WARNING' ELSE 'DRIFT_DETECTED' END AS psi_status
FROM pk"""


@q("kl_divergence")
def kl_divergence(spark, d):
    return D.kl_divergence(drift_long(spark, d))


SQL["kl_divergence"] = _BASE + "SELECT feature, round(kl, 6) AS kl_divergence FROM kl"


@q("ks_statistic")
def ks_statistic(spark, d):
    return D.ks_statistic(drift_long(spark, d))


SQL["ks_statistic"] = _BASE + "SELECT feature, round(d, 6) AS ks_statistic FROM ks0"


@q("ks_pvalue")
def ks_pvalue(spark, d):
    return D.ks_pvalue(drift_long(spark, d))


SQL["ks_pvalue"] = _BASE + "SELECT feature, round(d, 6) AS ks_statistic, round(pv, 6) AS ks_pvalue FROM ksp"


@q("mean_shift")
def mean_shift(spark, d):
    return D.mean_shift(drift_long(spark, d))


SQL["mean_shift"] = _BASE + """
SELECT feature, round(ref_mean, 6) AS reference_mean, round(prod_mean, 6) AS production_mean,
       round(ref_std, 6) AS reference_std, round(ms.shift, 6) AS mean_shift
FROM m JOIN ms USING (feature)"""

_REPORT_SELECT = """
SELECT m.feature, CAST(m.n_ref AS BIGINT) AS n_reference, CAST(m.n_prod AS BIGINT) AS n_production,
  CASE WHEN ksp.pv < 0.01 OR ms.shift > 2.0 THEN 'DRIFT_DETECTED'
       WHEN ksp.pv < 0.05 OR ms.shift > 1.0 THEN 'WARNING' ELSE 'OK' END AS drift_status,
  round(ksp.d, 6) AS ks_statistic, round(ksp.pv, 6) AS ks_pvalue, round(ms.shift, 6) AS mean_shift,
  round(m.ref_mean, 6) AS reference_mean, round(m.prod_mean, 6) AS production_mean,
  round(pk.psi, 6) AS psi,
  CASE WHEN pk.psi < 0.1 THEN 'OK' WHEN pk.psi < 0.2 THEN 'WARNING' ELSE 'DRIFT_DETECTED' END AS psi_status,
  round(kl.kl, 6) AS kl_divergence
FROM m JOIN ksp USING (feature) JOIN ms USING (feature) JOIN pk USING (feature) JOIN kl USING (feature)
WHERE m.n_prod >= 5 AND m.n_ref > 0"""


@q("drift_report")
def drift_report(spark, d):
    return D.drift_report(drift_long(spark, d))


SQL["drift_report"] = _BASE + _REPORT_SELECT


@q("drift_summary")
def drift_summary(spark, d):
    long = drift_long(spark, d)
    return D.drift_summary(D.drift_report(long), long)


SQL["drift_summary"] = _BASE + ", rep AS (" + _REPORT_SELECT + """)
SELECT CASE WHEN (SELECT count(*) FROM long WHERE side = 'production') = 0 THEN 'NO_DATA'
            WHEN (SELECT count(*) FROM long WHERE side = 'reference') = 0 THEN 'NO_REFERENCE'
            WHEN count(*) FILTER (WHERE drift_status = 'DRIFT_DETECTED') > 0 THEN 'DRIFT_DETECTED'
            WHEN count(*) FILTER (WHERE drift_status = 'WARNING') > 0 THEN 'WARNING' ELSE 'OK' END AS status,
       count(*) AS total_features_checked,
       count(*) FILTER (WHERE drift_status = 'DRIFT_DETECTED') AS drift_detected,
       count(*) FILTER (WHERE drift_status = 'WARNING') AS warnings
FROM rep"""


@q("drift_eligibility")
def drift_eligibility(spark, d):
    return D.drift_eligibility(drift_long(spark, d, extra_prod=True))


SQL["drift_eligibility"] = f"""WITH {drift_long_sql(extra_prod=True)},
rf AS (SELECT DISTINCT feature FROM long WHERE side = 'reference'),
pr AS (SELECT feature, count(*) AS n_raw, count(value) AS n_valid FROM long WHERE side = 'production' GROUP BY feature)
SELECT pr.feature, CAST(n_raw AS BIGINT) AS n_raw, CAST(n_valid AS BIGINT) AS n_valid,
  CASE WHEN rf.feature IS NULL THEN 'UNKNOWN' WHEN n_valid < 5 THEN 'INSUFFICIENT' ELSE 'READY' END AS status
FROM pr LEFT JOIN rf USING (feature)"""


@q("drift_overview")
def drift_overview(spark, d):
    long = drift_long(spark, d)
    out = D.drift_overview(long.filter(F.col("side") == D.PROD), long.filter(F.col("side") == D.REF), prediction_log(spark, d))
    return out.select("status", "total_features_checked", "drift_detected", "warnings",
                      F.col("prediction_stats.total_predictions").alias("total_predictions"),
                      F.col("prediction_stats.risk_rate").alias("risk_rate"))


SQL["drift_overview"] = "SELECT s.*, p.total_predictions, p.risk_rate FROM (" + SQL["drift_summary"] + f""") s,
  (WITH {LOG_SQL} SELECT count(*) AS total_predictions, round(coalesce(avg(prediction), 0.0), 6) AS risk_rate FROM log) p"""


N_DAYS = 90


@q("drift_last_days")
def drift_last_days(spark, d):
    """Production is the last 90 days of the log, which comes in three batches; the last one brings rows of days
    that the window holds already."""
    rows = load(spark, d, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", *[F.col(c).cast("double").alias(c) for c in DRIFT_FEATURES])
    long = rows.unpivot(["day", "l_orderkey"], DRIFT_FEATURES, "feature", "value")
    recent, odd = F.col("day") >= F.lit("2001-09-01").cast("date"), F.col("l_orderkey") % 2 == 1
    batches = [long.filter(~recent), long.filter(recent & ~odd), long.filter(recent & odd)]
    return DD.drift_last_days(drift_long(spark, d), [b.drop("l_orderkey") for b in batches], N_DAYS, storage_path(spark, "drift_days", uuid.uuid4().hex))


SQL["drift_last_days"] = _BASE.replace(
    "FROM lineitem WHERE l_returnflag IN ('A', 'R')",
    "FROM lineitem WHERE l_returnflag = 'A' OR (l_returnflag = 'R' AND CAST(l_shipdate AS DATE) > "
    f"(SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_returnflag = 'R') - INTERVAL {N_DAYS} DAYS)") + _REPORT_SELECT
