"""Training, search and evaluation on Spark ML.

Metrics are computed by the aggregate operators in operators/classify.py on
the scored DataFrame (no collect of predictions).  Fits are independent Spark
jobs; fold-level loops run with a small thread pool so several fits share the
cluster, exactly like ``CrossValidator(parallelism=k)``.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurewatch.ml.expressions import Compiled, Tree, compile_model
from featurewatch.ml.logistic import ALL, FoldFits, supports
from featurewatch.ml.split import hash_order, stratified_folds
from featurewatch.operators import classify as C
from featurewatch.operators.ordering import global_row_number
from featurewatch.session import let_workers_import, materialize

SEED = 42
N_ITER = 50
CV_FOLDS = 5
OVERFIT_GAP = 0.05
UNDERFIT_F1 = 0.7
#: Training rows that the fits running at the same time keep in memory.
ROWS_AT_ONCE = 100_000_000


def scored(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability of class 1 and the 0/1 prediction at ``threshold``."""
    out = model.transform(df)
    p1 = vector_to_array(F.col("probability"))[1]
    return out.withColumn("p1", p1).withColumn("yhat", (F.col("p1") >= threshold).cast("int"))


def metrics(pred: DataFrame, label: str = "label") -> DataFrame:
    """A9 + A10 on a scored frame: one row of accuracy, precision, recall, F1, AUC."""
    m = C.classification_metrics(pred, label, "yhat")
    return m.withColumn("auc_roc", C.auc_roc(pred, label, "p1").select("auc_roc").scalar())


def _tuned_from(pipeline: Pipeline, cand: list) -> int:
    """Place of the first stage that a candidate changes: what comes before is the same for all candidates."""
    stages, tuned = pipeline.getStages(), {p.parent for c in cand for p in c}
    return next((i for i, s in enumerate(stages) if s.uid in tuned), len(stages) - 1)


def _column_params(stages: list) -> set[str]:
    """Names of the columns that estimators read or write."""
    return {s.getOrDefault(p) for s in stages for p in s.params if p.name.endswith("Col") and s.isDefined(p)}


def random_search(df: DataFrame, pipeline: Pipeline, grid: list, label: str = "label", key: str = "id",
                  n_iter: int = N_ITER, folds: int = CV_FOLDS, seed: int = SEED, parallelism: int = 8):
    """M8: ``n_iter`` seeded samples of the grid, stratified k folds, F1 of class 1,
    refit of the best on all rows.  Returns (best model, table of candidates).

    The stages before the first one that the candidates change (medians, vectors)
    are fitted once a fold, on its training rows, and serve all candidates.
    Candidates that differ in the iteration limit alone share a fit where it
    ended before the lowest limit: a higher one would give the same model.
    Logistic regressions are fitted by the same passes over the rows (ml/logistic.py)."""
    rng = random.Random(seed)
    cand = grid if len(grid) <= n_iter else rng.sample(grid, n_iter)
    fdf = materialize(stratified_folds(df, key, label, k=folds, seed=seed))
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    limit = lambda c: next((v for p, v in c.items() if p.name == "maxIter"), 0)
    alike: dict[tuple, list[int]] = {}
    for i, c in enumerate(cand):
        alike.setdefault(tuple(sorted((p.name, str(v)) for p, v in c.items() if p.name != "maxIter")), []).append(i)
    together = FoldFits(fdf, pipeline, [*range(folds), ALL]) if supports(pipeline) else None
    if together and together.usable:
        parts = _search_together(together, cand, list(alike.values()), ev, folds)
    else:
        parts = _search_apart(fdf, pipeline, cand, list(alike.values()), ev, limit, folds, parallelism)
    mean = {i: sum(p[i] for p in parts if i in p) / folds for i in range(len(cand))}
    best = max(mean, key=lambda i: (mean[i], -i))
    table = df.sparkSession.createDataFrame(sorted(mean.items()), "candidate int, mean_f1 double")
    if together and together.usable:
        model = _fitted(together, [ALL], cand[best])[0]
    else:
        model = pipeline.fit(df, cand[best])
    if together:
        together.close()
    return model, table


def _search_together(fits: FoldFits, cand: list, alike: list[list[int]], ev: MulticlassClassificationEvaluator, folds: int) -> list[dict[int, float]]:
    """F1 of class 1 of each candidate in each fold, all fits by the same passes.  Candidates that differ in the iteration
    limit alone are one path, read at each limit."""
    limit = lambda i: next((v for p, v in cand[i].items() if p.name == "maxIter"), fits.last.getMaxIter())
    jobs = [(f, {p.name: v for p, v in cand[members[0]].items()}, sorted({limit(i) for i in members})) for f in range(folds) for members in alike]
    found = fits.fit(jobs)
    per = len(alike)
    points = {f: [found[f * per + g][limit(i)] for g, members in enumerate(alike) for i in members] for f in range(folds)}
    order = [i for members in alike for i in members]
    by_count = ev.copy({ev.weightCol: "n"})
    spark, done = fits.spark, {}

    def f1(counts: tuple[float, ...]) -> float:
        if counts not in done:                                # the evaluator sees a row for each label and prediction that occurs
            cells = [(float(k // 2), float(k % 2), n) for k, n in enumerate(counts) if n]
            done[counts] = by_count.evaluate(spark.createDataFrame(cells, f"`{ev.getLabelCol()}` double, prediction double, n double"))
        return done[counts]

    counts = fits.counts(points)
    return [{i: f1(tuple(counts[f][:, place].tolist())) for place, i in enumerate(order)} for f in range(folds)]


def _fitted(fits: FoldFits, folds: Sequence[int], params: dict | None = None) -> list[PipelineModel]:
    """The pipeline fitted on the rows outside each of ``folds``."""
    params = params or {}
    named = {p.name: v for p, v in params.items()}
    most = named.get("maxIter", fits.last.getMaxIter())
    return [fits.model(f, found[most], params) for f, found in zip(folds, fits.fit([(f, named, [most]) for f in folds]), strict=True)]


def _search_apart(fdf: DataFrame, pipeline: Pipeline, cand: list, alike: list[list[int]], ev: MulticlassClassificationEvaluator, limit: Callable,
                  folds: int, parallelism: int) -> list[dict[int, float]]:
    """F1 of class 1 of each candidate in each fold, by a fit for each that does not share one."""
    first = _tuned_from(pipeline, cand)
    common, tuned = Pipeline(stages=pipeline.getStages()[:first]), Pipeline(stages=pipeline.getStages()[first:])
    used = _column_params(tuned.getStages())
    # every fit reads the rows again: they are kept as columns, without those that no stage reads
    inputs = used.union(*[s.getInputCols() if s.hasParam("inputCols") else _column_params([s]) for s in common.getStages()])
    kept = fdf.select(*[c for c in fdf.columns if c in inputs], "fold").persist(StorageLevel.MEMORY_AND_DISK)
    at_once = max(1, min(parallelism, ROWS_AT_ONCE // max(1, kept.count())))

    def prepared(fold):
        out = common.fit(kept.filter(F.col("fold") != fold)).transform(kept)
        return out.select(*[c for c in out.columns if c in used], "fold")

    def one(job):
        fold, members = job
        train, test = (rows[fold].filter(c) for c in (F.col("fold") != fold, F.col("fold") == fold))
        scores, done = {}, None
        for i in sorted(members, key=lambda i: limit(cand[i])):
            if done is None:
                model = tuned.fit(train, cand[i])
                last = ev.evaluate(model.transform(test))
                est = model.stages[-1]
                if getattr(est, "hasSummary", False) and 0 < est.summary.totalIterations < limit(cand[i]):
                    done = last
            scores[i] = last
        return scores

    with ThreadPoolExecutor(max_workers=at_once) as ex:
        rows = list(ex.map(prepared, range(folds)))
        parts = list(ex.map(one, [(f, members) for f in range(folds) for members in alike]))
    kept.unpersist()
    return parts


def _parallel(spark, fn: Callable, jobs: Sequence, parallelism: int) -> DataFrame:
    """Independent fits in a few threads; their small result tables are united."""
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        parts = list(ex.map(fn, jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(df: DataFrame, make: Callable[[], Pipeline], label: str = "label", key: str = "id",
                   folds: int = CV_FOLDS, seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """Fresh fit per fold, 5 metrics per fold -> long table (metric, fold, value).
    The folds are stored once; each fold's metrics are computed when it is fitted.
    Logistic regressions are fitted by the same passes over the rows (ml/logistic.py)."""
    fdf = materialize(stratified_folds(df, key, label, k=folds, seed=seed))
    pipeline = make()
    together = FoldFits(fdf, pipeline, range(folds)) if supports(pipeline) else None
    models = _fitted(together, range(folds)) if together and together.usable else None
    if together:
        together.close()

    def one(i):
        model = models[i] if models else make().fit(fdf.filter(F.col("fold") != i))
        m = metrics(scored(model, fdf.filter(F.col("fold") == i)), label)
        return m.unpivot([], ["accuracy", "precision", "recall", "f1_score", "auc_roc"], "metric", "value") \
            .withColumn("fold", F.lit(i))

    return _parallel(df.sparkSession, one, range(folds), parallelism)


def learning_curve(df: DataFrame, make: Callable[[], Pipeline], label: str = "label", key: str = "id",
                   sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)), folds: int = CV_FOLDS,
                   seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """F1 on train and validation folds for nested training fractions
    (10 %..100 % of each fold's own training rows, in the hash order of the
    folds), mean and std per size, and the diagnosis overfit / underfit / healthy."""
    num, txt = hash_order(F.col(key), seed)
    fdf = stratified_folds(df, key, label, k=folds, seed=seed).withColumn("__h", num).withColumn("__ht", txt)
    fdf = materialize(fdf)
    # the rank of a row among the training rows of each fold: all folds are ranked in one pass
    others = F.filter(F.array(*[F.lit(i) for i in range(folds)]), lambda i: i != F.col("fold"))
    ranked = materialize(global_row_number(fdf.withColumn("__of", F.explode(others)), ["__h", "__ht"], groups=["__of"], name="__pos", count="__n"))
    trains = [ranked.filter(F.col("__of") == i) for i in range(folds)]

    def one(args):
        size, i = args
        train = trains[i].filter(F.col("__pos") <= F.round(F.lit(float(size)) * F.col("__n")))
        model = make().fit(train)
        tr = C.classification_metrics(scored(model, train), label, "yhat").select(F.col("f1_score").alias("train_f1"))
        va = C.classification_metrics(scored(model, fdf.filter(F.col("fold") == i)), label, "yhat") \
            .select(F.col("f1_score").alias("val_f1"))
        return tr.withColumn("val_f1", va.scalar()).withColumn("size", F.lit(float(size))).withColumn("fold", F.lit(i))

    allp = _parallel(df.sparkSession, one, [(s, i) for s in sizes for i in range(folds)], parallelism)
    g = allp.groupBy("size").agg(F.avg("train_f1").alias("train_mean"), F.stddev_pop("train_f1").alias("train_std"),
                                 F.avg("val_f1").alias("val_mean"), F.stddev_pop("val_f1").alias("val_std"))
    gap = F.col("train_mean") - F.col("val_mean")
    diag = F.when(gap > OVERFIT_GAP, "overfit").when(F.col("val_mean") < UNDERFIT_F1, "underfit").otherwise("healthy")
    return g.select("size", *[F.round(c, 6).alias(c) for c in ("train_mean", "train_std", "val_mean", "val_std")],
                    diag.alias("diagnosis"))


def importance_native(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float]] | None:
    """M12 first choice: tree importances; ``None`` for a model without trees (also a linear one, as in the reference)."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return None
    return sorted(zip(names, map(float, last.featureImportances.toArray()), strict=True), key=lambda t: -t[1])


def importance_of_nodes(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """M12 first choice as a query over the stored trees of a boosted model (``nodeData``): each split adds its gain,
    weighted by its rows, to its feature; shares of the sum over all trees."""
    n = F.col("nodeData")
    rows = F.when(F.size(n["impurityStats"]) > 0, n["impurityStats"][0]).otherwise(n["rawCount"])
    gains = nodes.filter(n["leftChild"] >= 0).groupBy(n["split"]["featureIndex"].alias("i")).agg(F.sum(n["gain"] * rows).alias("g"))
    total = gains.agg(F.sum("g")).scalar()
    named = nodes.sparkSession.createDataFrame(list(enumerate(names)), "i int, feature string")
    return named.join(gains, "i", "left").select("feature", F.coalesce(F.try_divide(F.col("g"), total), F.lit(0.0)).alias("importance"))


def importance_table(spark, pairs: Sequence[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "feature string, importance double")


def _donors(rows: DataFrame, key: str, repeats: int, seed: int) -> DataFrame:
    """(key, __p, __donor): in repeat p the row at rank r of the key order is paired with the row at rank r of a hash
    order.  All orders are ranked in one pass over the keys alone."""
    orders = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("h")),
                     *[F.struct(F.lit(r).alias("p"), F.xxhash64(F.col(key), F.lit(seed + r)).alias("h")) for r in range(repeats)])
    ranked = global_row_number(rows.select(key, F.inline(orders)), ["h", key], groups=["p"], name="__r")
    return ranked.filter("p = -1").select(key, "__r").join(
        ranked.filter("p >= 0").select("__r", F.col("p").alias("__p"), F.col(key).alias("__donor")), "__r").drop("__r")


def _tree_hits(trees: list[tuple[float, Tree]], k: int, label: str):
    """Counts rows that weighted trees over ``k`` inputs get right, with each input replaced by the donor's (place -1:
    none replaced)."""
    def run(batches):
        hits: dict[int, np.ndarray] = {}
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            own, donor = (get(c).flatten().to_numpy().reshape(-1, k) for c in ("__x", "__d"))
            y, repeat = get(label).to_numpy(), get("__p").to_numpy()
            n = len(own)
            change = np.zeros((k + 1, n))                     # of the margin; the last: none
            base = np.zeros(n)
            for w, tree in trees:
                value = tree.evaluate(lambda i: own[:, i], n)  # noqa: B023
                base += w * value
                for j in tree.used():
                    change[j] += w * (tree.evaluate(lambda i: donor[:, i] if i == j else own[:, i], n) - value)  # noqa: B023
            right = ((1.0 - 1.0 / (1.0 + np.exp(2.0 * (base + change))) >= 0.5) == (y == 1))
            for p in np.unique(repeat).tolist():
                hits[p] = hits.get(p, 0) + right[:, repeat == p].sum(axis=1)
        rows = [(p, j if j < k else -1, int(v)) for p, counts in hits.items() for j, v in enumerate(counts.tolist())]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["__p", "j", "hits"])
    return run


def importance_permutation(model: PipelineModel | Compiled, df: DataFrame, names: Sequence[str], label: str = "label", key: str = "id",
                           repeats: int = 5, seed: int = SEED) -> DataFrame:
    """M12 fallback: accuracy drop when one feature is shuffled, mean over repeats (unrounded: a mean of exact counts).

    Each row meets one donor row per repeat and keeps its own margin; what
    replacing feature j changes is added to it: the coefficient times the
    difference for a linear model, the trees that split on j for boosted ones.
    So ``rows x repeats`` rows are scored, however many features there are."""
    compiled = model if isinstance(model, Compiled) else compile_model(model, names)
    k = len(compiled.inputs)
    rows = df.select(key, F.col(label).cast("int").alias(label), F.array(*compiled.inputs).alias("__x"))
    pairs = _donors(rows, key, repeats, seed).join(rows, key).join(
        rows.select(F.col(key).alias("__donor"), F.col("__x").alias("__d")), "__donor").select("__p", label, "__x", "__d")
    if compiled.trees is not None:
        let_workers_import(df.sparkSession)
        hits = pairs.mapInArrow(_tree_hits(compiled.trees, k, label), "__p int, j int, hits long").groupBy("__p", "j").agg(F.sum("hits").alias("hits"))
    else:
        x, d = F.col("__x"), F.col("__d")
        margins = pairs.withColumn("__m", compiled.margin(lambda i: x[i]))
        right = lambda m: F.count_if((compiled.probability_of(m) >= 0.5) == (F.col(label) == 1))
        counts = margins.groupBy("__p").agg(right(F.col("__m")).alias("c-1"), *[
            right(F.col("__m") + F.lit(c) * (d[j] - x[j])).alias(f"c{j}") for j, c in enumerate(compiled.coefficients)])
        hits = counts.select("__p", F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"c{j}").alias("hits")) for j in range(-1, k)])))
    per = hits.groupBy("j").agg(F.sum("hits").alias("hits"))
    n = F.lit(repeats) * df.agg(F.count(F.lit(1))).scalar()
    whole = per.filter("j = -1").select("hits").scalar()
    named = F.get(F.array(*[F.lit(name) for name in compiled.names]), F.col("j"))
    return per.filter("j >= 0").select(named.alias("feature"), F.round((whole - F.col("hits")) / n, 6).alias("importance"))


def importances(model: PipelineModel, df: DataFrame, names: Sequence[str], label: str = "label", key: str = "id") -> list[tuple[str, float]]:
    """Native, else by permutation over ``df``, else uniform; greatest first.  The table has one row per feature."""
    pairs = importance_native(model, names)
    if pairs is None:
        try:
            table = importance_permutation(model, df, names, label, key)
        except ValueError:                                    # no expression for the model
            table = uniform_importance(df.sparkSession, names)
        pairs = sorted(((r.feature, r.importance) for r in table.collect()), key=lambda t: (-t[1], t[0]))
    return pairs


def uniform_importance(spark, names: Sequence[str]) -> DataFrame:
    """M12 last resort: 1 / k for every feature."""
    return importance_table(spark, [(n, 1.0 / len(names)) for n in names])
