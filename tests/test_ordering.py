"""Running sums, row numbers and percentiles by ranges: NULL groups, numbers of ranges, exactness, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurewatch.functions.encode import impute_median
from featurewatch.ml.split import stratified_folds, stratified_split
from featurewatch.operators.classify import auc_roc
from featurewatch.operators.concept import concept_windows
from featurewatch.operators.drift import drift_report
from featurewatch.operators.log_stats import exact_percentiles, log_retention
from featurewatch.operators.ordering import PART, global_row_number, placed, running_sums


@pytest.mark.parametrize("buckets", [2, 7, 40, 512, 2000])
def test_running_sums_keep_null_groups_and_ties(spark, buckets):
    rng = np.random.default_rng(buckets)
    rows = [(["a", None, "b"][i % 3], float(rng.integers(0, 50)), 1) for i in range(600)] + [("a", None, 1), (None, None, 1)]
    got = running_sums(spark.createDataFrame(rows, "g string, x double, c int"), ["g"], ["x"], {"cum": F.col("c")}, buckets=buckets).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for g, x, _ in rows if g == r.g]
        assert r.cum == sum(1 for x in own if x is None or (r.x is not None and x <= r.x))


def test_row_numbers_over_null_and_plain_groups(spark):
    rows = [(None if i % 2 else "m", i) for i in range(300)]
    got = global_row_number(spark.createDataFrame(rows, "g string, k long"), ["k"], groups=["g"]).collect()
    assert sorted((str(r.g), r.k, r.rn) for r in got) == sorted((str(g), k, k // 2 + 1) for g, k in rows)


def jobs_of(spark, fn):
    """Number of Spark jobs that ``fn`` runs."""
    spark.sparkContext.setJobGroup(group := f"jobs-{id(fn)}", "")
    try:
        fn()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("buckets", [8, 2000])
def test_the_plan_does_not_grow_with_the_ranges(spark, buckets):
    df = spark.range(20_000).select((F.col("id") % 997).cast("double").alias("x"), F.lit(1).alias("c"))
    out = []
    assert jobs_of(spark, lambda: out.append(running_sums(df, [], ["x"], {"cum": F.col("c")}, buckets=buckets).agg(F.max("cum").alias("m")))) <= 3
    assert out[0].collect()[0].m == 20_000
    plan = out[0]._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" not in plan and "Join" not in plan and "Broadcast" not in plan and len(plan) < 40_000
    assert "*(" in plan and "MapInArrow" not in plan                  # what is beside the windows is generated code


def test_facts_are_those_of_the_whole_group(spark):
    rows = [([None, "a", "b"][i % 3], float(i % 50), i % 7) for i in range(600)]
    facts = {"n": ("sum", F.lit(1)), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")), "s": ("sum", F.col("x") * F.col("c"))}
    got = running_sums(spark.createDataFrame(rows, "g string, x double, c int"), ["g"], ["x"], {"cum": F.col("c")}, buckets=9, facts=facts).collect()
    assert len(got) == 600
    for r in got:
        own = [(x, c) for g, x, c in rows if g == r.g]
        assert (r.n, r.lo, r.hi, r.s) == (len(own), min(own)[0], max(own)[0], sum(x * c for x, c in own))


@pytest.mark.parametrize(("build", "most"), [
    # adaptive execution runs a job for each shuffle: of the values (where they are reduced first), the sample, the ranges, the write
    (lambda df: stratified_split(df, "id", "y"), 3), (lambda df: concept_windows(df, "id", "y", "y"), 3),
    (lambda df: exact_percentiles(df, "x", [0.5], groups=["y"]), 4), (lambda df: impute_median(df, ["x"]), 4), (lambda df: auc_roc(df, "y", "x"), 4),
    (lambda df: drift_report(df.select(F.lit("x").alias("feature"), F.when(F.col("y") == 1, "reference").otherwise("production").alias("side"), "x").withColumnRenamed("x", "value")), 6)])
def test_few_jobs_run_while_a_plan_is_built(spark, build, most):
    df = spark.range(5000).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 7919 % 4999).cast("double").alias("x"))
    out = []
    assert jobs_of(spark, lambda: out.append(build(df))) <= most
    assert out[0].count() > 0


def test_rows_of_one_group_are_ranked_by_several_tasks(spark):
    rows = placed(spark.range(100_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 100_003).alias("x")), ["g"], ["x"], buckets=16)
    sizes = [r["count"] for r in rows.groupBy(PART).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 100_000 / 16


def test_percentiles_by_group_and_medians_without_a_single_task(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=101).round(1), None: rng.normal(size=40).round(1)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r.g: (r.p_0, r.p_1) for r in exact_percentiles(df, "v", [0.5, 0.9], groups=["g"]).collect()}
    for g, vs in values.items():
        assert got[g] == pytest.approx(tuple(np.percentile(vs, [50, 90])))
    frame = spark.createDataFrame([(1.0, 5, None), (None, 7, None), (4.0, None, None), (2.0, 8, None)], "x double, y int, z double")
    filled = impute_median(frame, ["x", "y", "z"])
    assert sorted((r.x, r.y, r.z) for r in filled.collect()) == [(1.0, 5, None), (2.0, 7, None), (2.0, 8, None), (4.0, 7, None)]
    plan = filled._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan


def test_split_and_folds_keep_null_labels(spark):
    df = spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(90)], "id long, y int")
    split = stratified_split(df, "id", "y")
    assert split.count() == 90 and split.filter("y is null and split = 'test'").count() == 6
    assert stratified_folds(df, "id", "y").groupBy("fold").count().orderBy("fold").collect()[0]["count"] == 18


def test_retention_is_a_filter_on_the_log(spark):
    log = spark.range(100).select(F.col("id").alias("seq"), F.lit("x").alias("v"))
    assert sorted(r.seq for r in log_retention(log, 7).collect()) == list(range(93, 100))
    assert log_retention(log, 1000).count() == 100 and log_retention(log.limit(0), 5).count() == 0
