"""Classification metrics as aggregates.

All metrics come from one pass of conditional counts (``count_if``) — the
confusion matrix — so they are a single partial/final aggregate at any
scale.  AUC uses the rank-sum formula over ``score -> (n_pos, n_neg)``
reduced counts, ranked with running sums by ranges (no global sort task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurewatch.operators.ordering import BUCKETS, running_sums


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Count and percentage per class of the target."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("t")).select("t").scalar()
    return g.select(label, "count", F.round(F.col("count") * 100.0 / total, 4).alias("percent"))


def confusion_counts(df: DataFrame, y: str, yhat: str, groups: list[str] | None = None) -> DataFrame:
    """TN, FP, FN, TP (optionally per group)."""
    t, p = F.col(y), F.col(yhat)
    aggs = [F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
            F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(*(groups or [])).agg(*aggs)


def metrics_from_counts(c: DataFrame, keep: list[str] | None = None, digits: int | None = 6) -> DataFrame:
    """Accuracy, precision, recall, F1 with zero division -> 0 (``digits=None``: unrounded)."""
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    acc = _safe_div(tp + tn, n)
    rnd = (lambda x: x) if digits is None else (lambda x: F.round(x, digits))
    return c.select(*(keep or []), rnd(acc).alias("accuracy"), rnd(prec).alias("precision"),
                    rnd(rec).alias("recall"), rnd(f1).alias("f1_score"))


def classification_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return metrics_from_counts(confusion_counts(df, y, yhat))


def auc_roc(df: DataFrame, label: str, score: str, buckets: int | None = BUCKETS) -> DataFrame:
    """A10: area under ROC via tie-averaged rank sums; one class only -> 0.0."""
    red = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
           .groupBy(score).agg(F.count_if(F.col(label) == 1).alias("npos"), F.count_if(F.col(label) == 0).alias("nneg")))
    cum = running_sums(red, [], [score], {"cum": F.col("npos") + F.col("nneg")}, buckets=buckets)
    cnt = F.col("npos") + F.col("nneg")
    avg_rank = F.col("cum") - cnt + (cnt + 1) / 2.0
    a = cum.agg(F.sum(F.col("npos") * avg_rank).alias("rpos"), F.sum("npos").alias("P"), F.sum("nneg").alias("N"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    auc = F.when((P > 0) & (N > 0), (F.col("rpos") - P * (P + 1) / 2) / (P * N)).otherwise(F.lit(0.0))
    return a.select(F.round(auc, 6).alias("auc_roc"), F.col("P").cast("long").alias("n_positive"),
                    F.col("N").cast("long").alias("n_negative"))


def classification_report(df: DataFrame, y: str, yhat: str, digits: int = 6) -> DataFrame:
    """Per class and macro / weighted averages of precision, recall, F1, support."""
    c = confusion_counts(df, y, yhat)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))

    def prf(tp_, fp_, fn_):
        p = _safe_div(tp_, tp_ + fp_)
        r = _safe_div(tp_, tp_ + fn_)
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        return p, r, f

    p1, r1, f1 = prf(tp, fp, fn)        # class 1
    p0, r0, f0 = prf(tn, fn, fp)        # class 0 (negatives as the positive class)
    s1, s0 = tp + fn, tn + fp
    tot = s0 + s1

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", _safe_div(p0 * s0 + p1 * s1, tot), _safe_div(r0 * s0 + r1 * s1, tot),
            _safe_div(f0 * s0 + f1 * s1, tot), tot))
    out = c.select(F.inline(rows))
    return out.select("class", *[F.round(x, digits).alias(x) for x in ("precision", "recall", "f1_score")],
                      F.col("support").cast("long").alias("support"))


def fold_summary(metrics_long: DataFrame, metric: str = "metric", fold: str = "fold",
                 value: str = "value", digits: int = 6) -> DataFrame:
    """Per metric mean and POPULATION std over folds, plus the fold list
    ordered by fold (bounded by the number of folds)."""
    g = metrics_long.groupBy(metric).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n_folds"),
        F.sort_array(F.collect_list(F.struct(F.col(fold), F.col(value)))).alias("__f"))
    return g.select(metric, F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"),
                    "n_folds", F.transform("__f", lambda s: s[value]).alias("folds"))
