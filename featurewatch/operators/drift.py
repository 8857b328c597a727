"""Data drift between a reference sample and production values.

Input of every operator is a *long* table ``(feature, side, value)`` with
``side`` in {"reference", "production"}; ``long_format`` builds it from wide
tables with ``unpivot``.  All features are processed by ONE plan keyed on
``feature`` (no per-feature loop, no driver-side arrays):

* the scan is reduced once to ``(feature, value) -> (n_ref, n_prod)``, a
  map-side combinable aggregate, so a hot value costs one row per task;
* the report ranks that reduced table once (``ordering``): cumulative counts for
  the KS statistic (H4/H5), and with them the range, sizes and sums of each
  feature, so the shared histogram (H1), PSI (H2), KL (H3) and the mean shift
  (H6) come from the same pass, without a join;
* the histogram alone stores the reduced table and attaches each feature's
  range, a table with one row per feature — bounded by the schema, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurewatch.functions.nulls import nan_to_null
from featurewatch.operators.ordering import BUCKETS, running_sums
from featurewatch.session import let_workers_import, materialize

REF, PROD = "reference", "production"

# Fixed values from the reference's monitoring thresholds.
KS_PVALUE_CRITICAL = 0.01
KS_PVALUE_WARNING = 0.05
MEAN_SHIFT_CRITICAL = 2.0
MEAN_SHIFT_WARNING = 1.0
PSI_WARNING = 0.1
PSI_CRITICAL = 0.2
HIST_EPS = 1e-6
MIN_PRODUCTION_VALUES = 5
DEFAULT_BINS = 10
#: Largest sample for the exact p-value.
EXACT_ROWS = 10_000

SEVERITY = {"OK": 0, "WARNING": 1, "DRIFT_DETECTED": 2}


# ----------------------------------------------------------------- inputs

def long_format(df: DataFrame, features: Sequence[str], side: str) -> DataFrame:
    """Wide table -> ``(feature, side, value)``; values coerced to double with
    bad text and NaN turned into NULL (dropped later)."""
    cols = [nan_to_null(F.col(f"`{c}`").try_cast("double")).alias(c) for c in features]
    return (df.select(*cols)
            .unpivot([], list(features), "feature", "value")
            .select("feature", F.lit(side).alias("side"), "value"))


def map_long_format(df: DataFrame, map_col: str, side: str) -> DataFrame:
    """Log-style ``MAP<STRING, STRING>`` of features -> long table (H10 coercion:
    values that do not parse as numbers become NULL and are dropped)."""
    return (df.select(F.explode(map_col).alias("feature", "raw"))
            .select("feature", F.lit(side).alias("side"),
                    nan_to_null(F.col("raw").try_cast("double")).alias("value")))


def restrict_to_reference(long: DataFrame) -> DataFrame:
    """Keep production features that the reference knows, before anything
    is shuffled.  The reference's features are the columns of a model's table,
    so the list is as small as a schema and is broadcast."""
    known = long.filter(F.col("side") == REF).select("feature").distinct()
    return long.join(F.broadcast(known), "feature", "left_semi")


def reduce_values(long: DataFrame) -> DataFrame:
    """``(feature, value) -> n_ref, n_prod`` over non-null values."""
    return (long.filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count_if(F.col("side") == REF).alias("n_ref"),
                 F.count_if(F.col("side") == PROD).alias("n_prod")))


# ---------------------------------------------------------- histogram (H1)

def _edge(i: int, lo: Column, hi: Column, bins: int) -> Column:
    """numpy.linspace(lo, hi, bins + 1)[i]: i * step + lo, the last edge exactly hi."""
    if i == bins:
        return hi
    return F.lit(float(i)) * ((hi - lo) / F.lit(float(bins))) + lo


def _bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy.histogram bin (1-based): number of edges <= x, last bin right-closed.
    Explicit comparisons (bins is fixed at plan time) keep codegen."""
    hits = sum((F.when(_edge(i, lo, hi, bins) <= x, 1).otherwise(0) for i in range(bins + 1)), F.lit(0))
    return F.least(hits, F.lit(bins))


def _bin_counts(bins: int) -> list[Column]:
    """Aggregates of rows with ``__bin``: both samples' counts of each bin."""
    return [F.sum(F.when(F.col("__bin") == k, F.col(c)).otherwise(0)).alias(f"__{c}{k}") for k in range(1, bins + 1) for c in ("n_ref", "n_prod")]


def binned(long: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    """One row per feature: sizes, range and the counts of each bin.  The reduced values are stored, because the bins need
    the range first; the ranges (a row per feature) are broadcast."""
    red = materialize(reduce_values(long))
    ends = red.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = red.join(F.broadcast(ends), "feature").withColumn("__bin", _bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
    return rows.groupBy("feature").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_prod").alias("n_prod"),
                                       F.first("lo").alias("lo"), F.first("hi").alias("hi"), *_bin_counts(bins))


def histogram_pair(long: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    """H1: shared equal-width histogram of both samples, proportions + eps."""
    lo, hi = F.col("lo"), F.col("hi")
    rows = F.array(*[F.struct(F.lit(k).alias("bin"), _edge(k - 1, lo, hi, bins).alias("lower_edge"), _edge(k, lo, hi, bins).alias("upper_edge"),
                              F.col(f"__n_ref{k}").alias("ref_count"), F.col(f"__n_prod{k}").alias("prod_count")) for k in range(1, bins + 1)])
    h = binned(long, bins).select("feature", "n_ref", "n_prod", F.inline(rows))
    return h.select("feature", "bin", "lower_edge", "upper_edge", "ref_count", "prod_count",
                    (F.try_divide(F.col("ref_count"), F.col("n_ref")) + HIST_EPS).alias("ref_share"),
                    (F.try_divide(F.col("prod_count"), F.col("n_prod")) + HIST_EPS).alias("prod_share"))


def _psi_kl(bins: int) -> tuple[Column, Column]:
    """PSI, and KL on the renormalised shares, of a row with the counts of each bin; what cannot be computed (a feature of
    one side only) counts as no drift."""
    # a feature seen on one side only has a zero count on the other: NULL, not an error
    r = [F.try_divide(F.col(f"__n_ref{k}"), F.col("n_ref")) + HIST_EPS for k in range(1, bins + 1)]
    p = [F.try_divide(F.col(f"__n_prod{k}"), F.col("n_prod")) + HIST_EPS for k in range(1, bins + 1)]
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    sr, sp = total(r), total(p)
    psi = total([(y - x) * F.log(y / x) for x, y in zip(r, p, strict=True)])
    kl = total([(y / sp) * F.log((y / sp) / (x / sr)) for x, y in zip(r, p, strict=True)])
    return F.coalesce(psi, F.lit(0.0)), F.coalesce(kl, F.lit(0.0))


def psi(long: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    """H2: PSI per feature (unrounded value and rounded 6)."""
    pk = binned(long, bins).select("feature", _psi_kl(bins)[0].alias("psi"))
    return pk.select("feature", F.round("psi", 6).alias("psi"), psi_band(F.col("psi")).alias("psi_status"))


def kl_divergence(long: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    """H3: KL(production || reference) over renormalised shares, rounded 6."""
    return binned(long, bins).select("feature", F.round(_psi_kl(bins)[1], 6).alias("kl_divergence"))


def psi_band(p: Column) -> Column:
    """H8: PSI band on the unrounded PSI."""
    return (F.when(p < PSI_WARNING, "OK").when(p < PSI_CRITICAL, "WARNING")
            .otherwise("DRIFT_DETECTED"))


# ---------------------------------------------------------------- KS (H4/H5)

def _cumulated(red: DataFrame, buckets: int | None, facts: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Reduced values with both cumulative counts (``cum_ref``, ``cum_prod``) and sample sizes (``tr``, ``tp``)."""
    return running_sums(red, ["feature"], ["value"], {"cum_ref": F.col("n_ref"), "cum_prod": F.col("n_prod")}, buckets=buckets,
                        facts={"tr": ("sum", F.col("n_ref")), "tp": ("sum", F.col("n_prod")), **(facts or {})})


def _gap() -> Column:
    """Aggregate: the greatest distance of the two empirical distribution functions."""
    return F.max(F.abs(F.try_divide(F.col("cum_ref"), F.col("tr")) - F.try_divide(F.col("cum_prod"), F.col("tp")))).alias("d")


def kolmogorov_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """H5: asymptotic two-sided p-value, 2 * sum (-1)^(k-1) exp(-2 k^2 lambda^2),
    lambda = D * sqrt(n1 n2 / (n1 + n2)); lambda < 0.3 -> 1.0 (series not converged)."""
    lam = d * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + 2.0 * F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def exact_pvalue(h: int, n1: int, n2: int) -> float:
    """P(D >= d) for samples without ties under equal distributions, d = h / (n1 n2): one less the chance that a
    random path from (0, 0) to (n1, n2) stays where |i n2 - j n1| < h, summed diagonal by diagonal."""
    if h <= 0:
        return 1.0
    small, large = sorted((n1, n2))
    i = np.arange(small + 1)
    inside = np.zeros(small + 1)
    inside[0] = 1.0
    for s in range(1, small + large + 1):
        j = s - i
        inside = inside * np.maximum(j, 0) / s + np.r_[0.0, inside[:-1]] * i / s
        inside[(j < 0) | (j > large) | (np.abs(i * large - j * small) >= h)] = 0.0
    return float(min(1.0, max(0.0, 1.0 - inside[small])))


def _exact_pvalues(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if pd.isna(x) or not a or not b else exact_pvalue(round(x * int(a) * int(b)), int(a), int(b))
                      for x, a, b in zip(d, n1, n2, strict=True)], dtype="float64")


def ks_pvalue_of(d: Column, n1: Column, n2: Column) -> Column:
    """Exact where both samples have at most ``EXACT_ROWS`` values, else asymptotic.  One row per feature comes here."""
    let_workers_import(SparkSession.active())
    few = F.greatest(n1, n2) <= EXACT_ROWS
    return F.when(few, F.pandas_udf(_exact_pvalues, T.DoubleType())(F.when(few, d), F.when(few, n1), F.when(few, n2))).otherwise(kolmogorov_pvalue(d, n1, n2))


def ks_statistic(long: DataFrame, buckets: int | None = BUCKETS) -> DataFrame:
    """H4: two-sample KS statistic per feature (max gap of the empirical CDFs)."""
    ks = _cumulated(reduce_values(long), buckets).groupBy("feature").agg(_gap())
    return ks.select("feature", F.round("d", 6).alias("ks_statistic"))


def ks_pvalue(long: DataFrame, buckets: int | None = BUCKETS) -> DataFrame:
    ks = _cumulated(reduce_values(long), buckets).groupBy("feature").agg(_gap(), F.first("tr").alias("tr"), F.first("tp").alias("tp"))
    return ks.select("feature", F.round("d", 6).alias("ks_statistic"),
                     F.round(ks_pvalue_of(F.col("d"), F.col("tr"), F.col("tp")), 6).alias("ks_pvalue"))


# ------------------------------------------------------------ mean shift (H6)

def _shift(m: DataFrame) -> Column:
    div = F.when(F.col("ref_std") > 1e-6, F.col("ref_std")).otherwise(F.lit(1.0))
    return F.abs(F.col("prod_mean") - F.col("ref_mean")) / div


def mean_shift(long: DataFrame) -> DataFrame:
    """H6: one aggregate over the values; the population std (numpy's np.std) is Spark's, which merges centred moments."""
    of = lambda side: F.when(F.col("side") == side, F.col("value"))
    m = long.filter(F.col("value").isNotNull()).groupBy("feature").agg(
        F.avg(of(REF)).alias("ref_mean"), F.avg(of(PROD)).alias("prod_mean"), F.stddev_pop(of(REF)).alias("ref_std"))
    return m.select("feature", F.round("ref_mean", 6).alias("reference_mean"),
                    F.round("prod_mean", 6).alias("production_mean"),
                    F.round("ref_std", 6).alias("reference_std"),
                    F.round(_shift(m), 6).alias("mean_shift"))


# ----------------------------------------------------------- report

def verdict(pvalue: Column, shift: Column) -> Column:
    """H7: DRIFT if p < .01 or shift > 2; WARNING if p < .05 or shift > 1; else OK."""
    return (F.when((pvalue < KS_PVALUE_CRITICAL) | (shift > MEAN_SHIFT_CRITICAL), "DRIFT_DETECTED")
            .when((pvalue < KS_PVALUE_WARNING) | (shift > MEAN_SHIFT_WARNING), "WARNING")
            .otherwise("OK"))


def drift_report(long: DataFrame, bins: int = DEFAULT_BINS, buckets: int | None = BUCKETS,
                 min_production: int = MIN_PRODUCTION_VALUES) -> DataFrame:
    """One row per feature that the reference knows (J7) with enough production values (H9)."""
    return report_from_reduced(reduce_values(restrict_to_reference(long)), bins, buckets, min_production)


def report_from_reduced(red: DataFrame, bins: int = DEFAULT_BINS, buckets: int | None = BUCKETS,
                        min_production: int = MIN_PRODUCTION_VALUES) -> DataFrame:
    """The report from ``reduce_values``'s table.  The range, sizes and means of a feature come with its ranked rows, so one
    pass over them gives the bins, the spread around the mean and the gap of the distributions."""
    v = F.col("value")
    rows = _cumulated(red, buckets, {"lo": ("min", v), "hi": ("max", v), "ref_sum": ("sum", v * F.col("n_ref")), "prod_sum": ("sum", v * F.col("n_prod"))})
    rows = rows.withColumn("ref_mean", F.try_divide(F.col("ref_sum"), F.col("tr"))).withColumn(
        "__bin", _bin_index(v, F.col("lo"), F.col("hi"), bins))
    one = rows.groupBy("feature").agg(
        _gap(), F.first("tr").alias("tr"), F.first("tp").alias("tp"), F.first("ref_mean").alias("ref_mean"),
        F.first(F.try_divide(F.col("prod_sum"), F.col("tp"))).alias("prod_mean"),
        F.sum(F.col("n_ref") * (v - F.col("ref_mean")) ** 2).alias("__squares"), *_bin_counts(bins))
    j = one.filter((F.col("tp") >= min_production) & (F.col("tr") > 0)).withColumns(
        {"n_ref": F.col("tr"), "n_prod": F.col("tp"), "ref_std": F.sqrt(F.col("__squares") / F.col("tr"))})
    psi, kl = _psi_kl(bins)
    j = j.withColumn("psi", psi).withColumn("kl", kl)
    shift = _shift(j)
    j = j.withColumn("__p", ks_pvalue_of(F.col("d"), F.col("tr"), F.col("tp")))
    p = F.col("__p")
    return j.select(
        "feature",
        F.col("n_ref").cast("long").alias("n_reference"),
        F.col("n_prod").cast("long").alias("n_production"),
        verdict(p, shift).alias("drift_status"),
        F.round("d", 6).alias("ks_statistic"),
        F.round(p, 6).alias("ks_pvalue"),
        F.round(shift, 6).alias("mean_shift"),
        F.round("ref_mean", 6).alias("reference_mean"),
        F.round("prod_mean", 6).alias("production_mean"),
        F.round("psi", 6).alias("psi"),
        psi_band(F.col("psi")).alias("psi_status"),
        F.round("kl", 6).alias("kl_divergence"),
    )


def drift_eligibility(long: DataFrame, min_production: int = MIN_PRODUCTION_VALUES) -> DataFrame:
    """H9: per production feature: UNKNOWN (not in the reference), INSUFFICIENT
    (< min non-null production values) or READY."""
    ref_feats = long.filter(F.col("side") == REF).select("feature").distinct().withColumn("known", F.lit(True))
    prod = (long.filter(F.col("side") == PROD).groupBy("feature")
            .agg(F.count(F.lit(1)).alias("n_raw"), F.count("value").alias("n_valid")))
    j = prod.join(ref_feats, "feature", "left")
    return j.select(
        "feature", F.col("n_raw").cast("long").alias("n_raw"), F.col("n_valid").cast("long").alias("n_valid"),
        F.when(F.col("known").isNull(), "UNKNOWN")
        .when(F.col("n_valid") < min_production, "INSUFFICIENT")
        .otherwise("READY").alias("status"))


def drift_summary(report: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Overall status with counts (H10): NO_DATA without production rows, NO_REFERENCE without reference rows (both from
    ``long``), else the worst feature verdict, OK if no feature could be checked."""
    sev = (F.when(F.col("drift_status") == "DRIFT_DETECTED", 2)
           .when(F.col("drift_status") == "WARNING", 1).otherwise(0))
    agg = report.agg(
        F.count(F.lit(1)).alias("total_features_checked"),
        F.count_if(F.col("drift_status") == "DRIFT_DETECTED").alias("drift_detected"),
        F.count_if(F.col("drift_status") == "WARNING").alias("warnings"),
        F.max(sev).alias("sev"))
    worst = F.when(F.col("sev") == 2, "DRIFT_DETECTED").when(F.col("sev") == 1, "WARNING").otherwise("OK")
    if long is None:
        status = F.when(F.col("total_features_checked") == 0, "NO_DATA").otherwise(worst)
    else:
        sides = long.agg(F.struct(F.count_if(F.col("side") == PROD).alias("prod"), F.count_if(F.col("side") == REF).alias("ref"))).scalar()
        status = F.when(sides["prod"] == 0, "NO_DATA").when(sides["ref"] == 0, "NO_REFERENCE").otherwise(worst)
    return agg.select(status.alias("status"), "total_features_checked", "drift_detected", "warnings")


def drift_overview(log_long: DataFrame, reference_long: DataFrame | None, log: DataFrame | None = None) -> DataFrame:
    """H10 as one row: the summary and, if the log is given, its prediction statistics (A1) as ``prediction_stats``.  A
    missing reference gives NO_REFERENCE; one without the columns of a long table gives ERROR."""
    from featurewatch.operators.log_stats import prediction_stats
    if reference_long is not None and not {"feature", "value"} <= set(reference_long.columns):
        none = F.lit(0).cast("long")
        out = log_long.agg(F.lit("ERROR").alias("status"), none.alias("total_features_checked"), none.alias("drift_detected"), none.alias("warnings"))
    else:
        prod = log_long.select("feature", F.lit(PROD).alias("side"), "value")
        long = prod if reference_long is None else prod.unionByName(reference_long.select("feature", F.lit(REF).alias("side"), "value"))
        out = drift_summary(drift_report(long), long)
    if log is not None:
        out = out.withColumn("prediction_stats", prediction_stats(log).select(F.struct("*").alias("s")).scalar())
    return out
