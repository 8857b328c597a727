"""Profiling and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurewatch.operators import quality as QU
from featurewatch.plans.q_features import Q as FEATURE_Q, preprocessed_orders
from featurewatch.sources.tables import SCHEMAS, load, scan_profile

Q, SQL = {}, {}


def q(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


@q("scan_profile")
def scan_profile_q(spark, d):
    return scan_profile(load(spark, d, "lineitem"))


SQL["scan_profile"] = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_non_null, count(*) - count({c}) AS n_null "
    f"FROM lineitem" for c in SCHEMAS["lineitem"].fieldNames())

# Declared catalog of lineitem-derived features (name, category, description, default).
CATALOG = [
    ("l_quantity", "Amounts", "units ordered", True),
    ("l_extendedprice", "Amounts", "line value", True),
    ("discount", "Rates", "discount share, missing when none", True),
    ("tax", "Rates", "tax share, missing when none", True),
    ("l_commit_lag", "Dates", "not present in the table", False),
]


def _li_features(spark, d):
    li = load(spark, d, "lineitem")
    return li.select("l_quantity", "l_extendedprice",
                     F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("discount"),
                     F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"))


_LI_FEAT_SQL = """t AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_discount > 0 THEN l_discount END AS discount,
  CASE WHEN l_tax > 0 THEN l_tax END AS tax FROM lineitem)"""


@q("feature_catalog_profile")
def feature_catalog_profile(spark, d):
    return QU.catalog_profile(_li_features(spark, d), CATALOG)


_CAT_VALUES = ", ".join(f"('{f}', '{c}', {str(dflt).lower()})" for f, c, _, dflt in CATALOG)
SQL["feature_catalog_profile"] = f"""WITH {_LI_FEAT_SQL},
cat(feature, category, is_default) AS (VALUES {_CAT_VALUES}),
prof AS (""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_rows, round((count(*) - count({c})) / count(*), 6) AS null_rate, "
    f"round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM t" for c, *_ in CATALOG[:4]) + """),
j AS (SELECT cat.feature, cat.category, cat.is_default, prof.n_rows IS NOT NULL AS present, prof.n_rows, prof.null_rate,
        prof.min, prof.max FROM cat LEFT JOIN prof USING (feature))
SELECT *, count(n_rows) OVER (PARTITION BY category) AS category_n_present,
  round(avg(null_rate) OVER (PARTITION BY category), 6) AS category_null_rate FROM j"""


@q("feature_summary")
def feature_summary(spark, d):
    feats = FEATURE_Q["pipeline_features"](spark, d)
    return QU.feature_summary(feats, ["years", "delta", "ratio", "row_std"])


def _summary_sql():
    from featurewatch.plans.q_features import SQL as FSQL
    base = FSQL["pipeline_features"]
    return "WITH pf AS (" + base + ")\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, "
        f"count({c}) AS n_non_null FROM pf" for c in ["years", "delta", "ratio", "row_std"])


SQL["feature_summary"] = _summary_sql()

DOC_COLS = ["text", "lang", "source", "n_chars", "quality", "toxic"]


@q("null_profile_tiers")
def null_profile_tiers(spark, d):
    docs = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    return QU.null_profile_tiers(docs, DOC_COLS)


SQL["null_profile_tiers"] = "WITH t AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),\np AS (" + \
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
        f"round((count(*) - count({c})) / count(*), 6) AS null_rate FROM t" for c in DOC_COLS) + """)
SELECT *, CASE WHEN null_rate < 0.3 THEN 'low' WHEN null_rate <= 0.6 THEN 'medium' ELSE 'high' END AS tier FROM p"""

LEAK_FEATURES = ["price", "priority_code", "status_code", "priority_num", "is_urgent"]


@q("leakage_screen")
def leakage_screen(spark, d):
    return QU.leakage_screen(preprocessed_orders(spark, d), "target", LEAK_FEATURES)


def _leak_sql():
    from featurewatch.plans.q_features import _PRE_SQL
    return f"WITH {_PRE_SQL}\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(target AS DOUBLE)), 6) AS corr, "
        f"coalesce(abs(corr(CAST({c} AS DOUBLE), CAST(target AS DOUBLE))) > 0.5, false) AS leak_suspect FROM pre"
        for c in LEAK_FEATURES)


SQL["leakage_screen"] = _leak_sql()
