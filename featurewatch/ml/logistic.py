"""Many logistic fits over the same rows, iterated together.

``LogisticRegression.fit`` passes over its rows once an iteration, so a search
of k candidates over f folds reads them k x f x (iterations) times.  Here all
fits take their steps together: one pass gives each of them the loss and the
gradient that it asks for.  The objective, the scaling and centring of the
features, the starting point, the optimisers (Breeze's L-BFGS, and OWL-QN with
an L1 penalty) and their stopping rules are those of Spark's own fit, so the
iterates are the same but for the order in which numbers are added.

Rows that agree in all that a fit reads (features, label, weight, fold) are
one row with a count, as equal terms of a sum: codes leave few, continuous
features leave all rows.  The passes run in the workers on blocks of numbers;
the driver gets one array of sums from each partition.  Few rows are iterated
over by one task, with the same steps.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurewatch.ml.median import ExactMedianImputer
from featurewatch.session import let_workers_import, materialize

#: Fold number of a fit on all rows.
ALL = -1
#: Numbers in a block at most (rows x columns).
BLOCK_VALUES = 1 << 18
#: Bytes of blocks up to which one task iterates over them by itself: less work than the passes' own cost.
ONE_TASK = 1 << 22
#: Corrections that the optimisers keep (fixed in Spark's fit).
MEMORY = 10
#: Values that the stopping rule looks back at (fixed in Breeze).
VALUES_SEEN = 20


# ------------------------------------------------------------- optimisers

class _Failed(Exception):
    """A search direction or a line search without result."""


Path = Generator[np.ndarray, tuple[float, np.ndarray], "dict[int, np.ndarray]"]


def _direction(grad: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """L-BFGS: minus the approximate inverse Hessian times the gradient; newest correction first."""
    d, a = grad.copy(), []
    scale = 1.0
    if steps:
        sy, yy = steps[0] @ changes[0], changes[0] @ changes[0]
        if sy < 0 or np.isnan(sy):
            raise _Failed
        scale = sy / yy
    for s, y in zip(steps, changes, strict=True):
        a.append((s @ d) / (s @ y))
        if np.isnan(a[-1]):
            raise _Failed
        d = d - a[-1] * y
    d = d * scale
    for s, y, ai in reversed(list(zip(steps, changes, a, strict=True))):
        d = d + (ai - (y @ d) / (s @ y)) * s
    return -d


def _between(left, right) -> float:
    """Cubic interpolation between two (t, slope, value), at least a tenth away from both."""
    if left[0] > right[0]:
        left, right = right, left
    (lt, ld, lv), (rt, rd, rv) = left, right
    d1 = ld + rd - 3 * (lv - rv) / (lt - rt)
    d2 = np.sqrt(d1 * d1 - ld * rd)
    t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return low if t < low else high if t > high else t


def _strong_wolfe(at: Callable, value: float, slope: float, t: float):
    """Step length by the strong Wolfe conditions; ``at(t)`` gives (t, slope, value)."""
    if slope > 0:
        raise _Failed
    enough = lambda p: p[2] <= value + 1e-4 * p[0] * slope
    flat = lambda p: abs(p[1]) <= 0.9 * abs(slope)

    def zoom(low, high):
        for _ in range(10):
            t = _between(low, high)
            if np.isnan(t):
                raise _Failed
            c = yield from at(t)
            if not enough(c) or c[2] >= low[2]:
                high = c
            else:
                if flat(c):
                    return c[0]
                if c[1] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    low = (0.0, slope, value)
    for i in range(10):
        c = yield from at(t)
        if not np.isfinite(c[2]):
            t /= 2.0
            continue
        if not enough(c) or (c[2] >= low[2] and i > 0):
            return (yield from zoom(low, c))
        if flat(c):
            return c[0]
        if c[1] > 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise _Failed


def _backtrack(at: Callable, value: float, slope: float, plain: float, t: float, shrink: float):
    """Step length of OWL-QN; ``plain``, the value without the L1 penalty, stands for that of the first trial, as in Breeze."""
    _, d, _ = yield from at(t)
    v = plain
    for i in range(1, 21):
        if v > value + t * slope * 1e-4:
            by = shrink
        elif d < 0.9 * slope:
            by = 2.1
        elif d > -0.9 * slope:
            by = shrink
        else:
            return t
        if i == 20:
            return t
        if t < 1e-10 or t > 1e10:
            raise _Failed
        t, d, v = yield from at(t * by)
    return t


def optimum(x: np.ndarray, limits: Sequence[int], tol: float, l1: np.ndarray | None = None) -> Path:
    """The path of Breeze's L-BFGS, or with ``l1`` (a penalty for each number) of its OWL-QN: yields points, takes (value,
    gradient) of each and gives the last point within each of the iteration ``limits``."""
    def adjusted(x, value, grad):
        if l1 is None:
            return value, grad
        at_zero = np.where(grad - l1 > 0, grad - l1, np.where(grad + l1 < 0, grad + l1, 0.0))
        return value + np.abs(l1 * x).sum(), np.where(l1 == 0, grad, np.where(x == 0, at_zero, grad + np.sign(x) * l1))

    value, grad = yield x
    adj, adj_grad = adjusted(x, value, grad)
    first, seen = adj, [np.inf]
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    failed = lost = False
    at_limit: dict[int, np.ndarray] = {}
    i = 0
    while True:
        at_limit |= {n: x for n in limits if n not in at_limit and i >= n}
        if lost or len(at_limit) == len(limits) or (len(seen) > 1 and abs(adj - max(seen)) <= tol * abs(first)) \
                or np.linalg.norm(adj_grad) <= max(tol * abs(adj), 1e-8):
            return {n: at_limit.get(n, x) for n in limits}
        try:
            d = _direction(adj_grad, steps, changes)
            if l1 is not None:
                d = np.where(d * adj_grad < 0, d, 0.0)
                orthant = np.where(x != 0, np.sign(x), np.sign(-adj_grad))
            last = None

            def point(t):
                p = x + d * t  # noqa: B023
                return p if l1 is None else np.where(np.sign(p) == np.sign(orthant), p, 0.0)  # noqa: B023

            def at(t):
                nonlocal last
                p = point(t)  # noqa: B023
                v, g = yield p
                last = (t, p, v, g)
                v, g = adjusted(p, v, g)
                return t, g @ d, v  # noqa: B023

            if l1 is None:
                t = yield from _strong_wolfe(at, value, grad @ d, 1.0 / np.linalg.norm(d) if i == 0 else 1.0)
                if t * np.linalg.norm(grad) < 1e-10:
                    raise _Failed
            else:
                t = yield from _backtrack(at, adj, adj_grad @ d, value, 0.5 / np.linalg.norm(grad) if i == 0 else 1.0, 0.1 if i == 0 else 0.5)
            if last[0] != t:
                yield from at(t)
            _, p, v, g = last
        except _Failed:
            if failed:
                lost = True
            else:
                failed, steps, changes = True, [], []
            continue
        steps, changes = [p - x, *steps][:MEMORY], [g - grad, *changes][:MEMORY]
        x, value, grad = p, v, g
        adj, adj_grad = adjusted(x, value, grad)
        seen, failed, i = [*seen, adj][-VALUES_SEEN:], False, i + 1


# ------------------------------------------------------ passes over the rows

def _block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(of, x: list, y, w, n, fold) as blocks: a row of numbers for each feature, then y, w, n and fold."""
    most = max(1, BLOCK_VALUES // (width + 4))
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        x = get("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        rest = [get(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "n", "fold")]
        of, blocks = [], []
        for i in range(0, len(x), most):
            part = np.empty((width + 4, len(x[i:i + most])))
            part[:width] = x[i:i + most].T
            part[width:] = [c[i:i + most] for c in rest]
            of.append(get("of")[i].as_py())
            blocks.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(blocks, pa.binary())], ["of", "block"])


def _added(batches: Iterator[pa.RecordBatch], width: int, jobs: dict[int, list], of: Callable, merge: Callable) -> Iterator[pa.RecordBatch]:
    """``of(rows of numbers, fold, job)`` for each fold of ``jobs``, merged over the blocks of a partition."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for whose, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            a = np.frombuffer(data.as_buffer()).reshape(width + 4, -1)
            for fold, job in jobs.items():
                if whose is None or whose == fold:
                    s = of(a, fold, job)
                    found[fold] = merge(found[fold], s) if fold in found else s
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["fold", "sums"])


def _training(a: np.ndarray, fold: int) -> np.ndarray:
    return a if fold == ALL else a[:, a[-1] != fold]


def _sizes(a: np.ndarray, fold: int, _) -> np.ndarray:
    """Sums (rows that no fit takes, weight, squared weights, weight of class 1, weighted features), then least and
    negated greatest features of the training rows."""
    a = _training(a, fold)
    x, y, w, n = a[:-4], a[-4], a[-3], a[-2]
    bad = ~(((y == 0) | (y == 1)) & (w >= 0) & np.isfinite(w) & np.isfinite(x).all(axis=0))
    ends = [x.min(axis=1), -x.max(axis=1)] if x.size else [np.full(len(x), np.inf)] * 2
    return np.concatenate([[n[bad].sum(), (w * n).sum(), (w * w * n).sum(), (w * n)[y == 1].sum()], x @ (w * n), *ends])


def _merge_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sums = 4 + (len(a) - 4) // 3
    return np.concatenate([a[:sums] + b[:sums], np.minimum(a[sums:], b[sums:])])


def _squares(a: np.ndarray, fold: int, mean: np.ndarray) -> np.ndarray:
    a = _training(a, fold)
    return (a[:-4] - mean[:, None]) ** 2 @ (a[-3] * a[-2])


def _losses(a: np.ndarray, fold: int, job: tuple) -> np.ndarray:
    """For each column of scaled coefficients (the last: the intercept of centred features): loss, then gradient."""
    mean, inverse, points = job
    a = _training(a, fold)
    x = (a[:-4] - mean[:, None]) * inverse[:, None]
    y, w = a[-4][:, None], (a[-3] * a[-2])[:, None]
    m = x.T @ points[:-1] + points[-1]
    e = np.exp(-np.abs(m))
    loss = w * (np.log1p(e) + np.where(m > 0, 0.0, -m) + (1 - y) * m)
    r = w * (np.where(m > 0, 1.0, e) / (1.0 + e) - y)
    return np.vstack([loss.sum(axis=0), x @ r, r.sum(axis=0)])


def _hits(a: np.ndarray, fold: int, points: np.ndarray) -> np.ndarray:
    """Rows of the fold itself, by label and prediction (0 0, 0 1, 1 0, 1 1), for each column of coefficients and
    intercept."""
    a = a[:, a[-1] == fold]
    yes = a[:-4].T @ points[:-1] + points[-1] > 0
    out = []
    for label in (0, 1):
        n = a[-2] * (a[-4] == label)
        out += [n @ ~yes, n @ yes]
    return np.array(out)


# -------------------------------------------------------------------- fits

@dataclass
class Scale:
    """Training rows of a fold: mean and inverse deviation (0: constant) of the features, weight, start of the intercept."""
    mean: np.ndarray
    inverse: np.ndarray
    weight: float
    start: float


@dataclass
class Job:
    """A fit in scaled features: fold, start, iteration limits, tolerance, and L1 and L2 penalties of each number."""
    fold: int
    start: np.ndarray
    limits: list[int]
    tol: float
    l1: np.ndarray | None
    l2: np.ndarray


def _iterated(jobs: Sequence[Job], scales: dict[int, Scale], one_pass: Callable[[dict], dict[int, np.ndarray]]) -> list[dict[int, np.ndarray]]:
    """The path of every job, each step of all of them by ``one_pass``: the last points within their iteration limits."""
    out: list[dict[int, np.ndarray]] = [{}] * len(jobs)
    paths = [optimum(j.start, j.limits, j.tol, j.l1) for j in jobs]
    asked = {i: next(p) for i, p in enumerate(paths)}
    while asked:
        of_fold: dict[int, list[int]] = {}
        for i in asked:
            of_fold.setdefault(jobs[i].fold, []).append(i)
        sums = one_pass({f: (scales[f].mean, scales[f].inverse, np.column_stack([asked[i] for i in members])) for f, members in of_fold.items()})
        for f, members in of_fold.items():
            table = sums[f].reshape(-1, len(members)) / scales[f].weight
            for place, i in enumerate(members):
                x, l2 = asked[i], jobs[i].l2
                with np.errstate(all="ignore"):
                    try:
                        asked[i] = paths[i].send((table[0, place] + 0.5 * (l2 * x * x).sum(), table[1:, place] + l2 * x))
                    except StopIteration as end:
                        del asked[i]
                        out[i] = end.value
    return out


def _in_one_task(batches: Iterator[pa.RecordBatch], width: int, jobs: Sequence[Job], scales: dict[int, Scale]) -> Iterator[pa.RecordBatch]:
    """All iterations over rows that one task holds."""
    rows: dict[int, list[np.ndarray]] = {f: [] for f in scales}
    for batch in batches:
        for whose, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            a = np.frombuffer(data.as_buffer()).reshape(width + 4, -1)
            for fold in scales if whose is None else [whose]:
                rows[fold].append(a)
    found = _iterated(jobs, scales, lambda turn: {f: functools.reduce(np.add, [_losses(a, f, job) for a in rows[f]]).ravel() for f, job in turn.items()})
    flat = [(i, n, x.tobytes()) for i, f in enumerate(found) for n, x in f.items()]
    job, at, point = zip(*flat, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(job, pa.int32()), pa.array(at, pa.int32()), pa.array(point, pa.binary())], ["job", "at", "point"])


def supports(pipeline: Pipeline) -> bool:
    """A logistic regression without bounds or thresholds of its own, alone or after medians and vector assembly."""
    *before, last = pipeline.getStages()
    if not isinstance(last, LogisticRegression) or [type(s) for s in before] not in ([], [ExactMedianImputer, VectorAssembler]):
        return False
    plain = not any(last.isSet(p) for p in last.params if "Bounds" in p.name or p.name == "thresholds")
    return plain and last.getFitIntercept() and last.getFamily() == "auto" and last.getThreshold() == 0.5


class FoldFits:
    """Logistic fits on the rows of ``df`` outside a fold (or ``ALL``).  ``usable`` is false where Spark's own fit has to
    decide: values that it refuses, or training rows of one class."""

    def __init__(self, df: DataFrame, pipeline: Pipeline, folds: Sequence[int], fold: str = "fold"):
        self.spark, self.last = df.sparkSession, pipeline.getStages()[-1]
        self.before = pipeline.getStages()[:-1]
        label, features = F.col(self.last.getLabelCol()), F.col(self.last.getFeaturesCol())
        weight = F.col(self.last.getWeightCol()) if self.last.isSet("weightCol") and self.last.getWeightCol() else F.lit(1.0)
        rest = [label.cast("double").alias("y"), weight.cast("double").alias("w"), F.col(fold).cast("int").alias("fold")]
        self.folds, self.scales, self.usable, self.blocks = list(folds), {}, False, None
        let_workers_import(self.spark)
        self.common: dict[int, PipelineModel] = {}
        if self.before:
            inputs = self.before[0].getInputCols()
            self.width = len(inputs)
            self.rows = materialize(df.select(*[F.col(f"`{c}`") for c in inputs], *rest).groupBy(*[f"`{c}`" for c in inputs], "y", "w", "fold")
                                    .agg(F.count(F.lit(1)).alias("n")))
            parts = [self._prepared(f) for f in self.folds]
        else:
            self.rows = df.select(F.when(features.isNotNull(), vector_to_array(features)).alias("x"), *rest, F.lit(1).cast("long").alias("n"))
            size = self.rows.agg(F.min(F.coalesce(F.size("x"), F.lit(-1))), F.max(F.size("x"))).first()
            if size[0] is None or size[0] != size[1] or size[0] < 1:
                return
            self.width = size[1]
            parts = [self.rows.withColumn("of", F.lit(None).cast("int"))]
        every = functools.reduce(DataFrame.union, [p.select("of", "x", "y", "w", "n", "fold") for p in parts])
        width = self.width
        self.blocks = every.mapInArrow(lambda b: _block(b, width), "of int, block binary").persist(StorageLevel.MEMORY_AND_DISK)
        self._measure()

    def _prepared(self, fold: int) -> DataFrame:
        """The rows with the medians of the fold's training rows."""
        imputer, assembler = self.before
        counted = imputer.copy({imputer.countCol: "n"})
        medians = counted.fit(self.rows.filter(F.col("fold") != fold))
        self.common[fold] = PipelineModel([medians, assembler])
        return self.common[fold].transform(self.rows).withColumn("x", vector_to_array(F.col(assembler.getOutputCol()))).withColumn("of", F.lit(fold))

    def close(self) -> None:
        if self.blocks is not None:
            self.blocks.unpersist()

    def _pass(self, jobs: dict[int, object], of: Callable, merge: Callable = np.add) -> dict[int, np.ndarray]:
        width, found = self.width, {}
        for r in self.blocks.mapInArrow(lambda b: _added(b, width, jobs, of, merge), "fold int, sums binary").collect():
            s = np.frombuffer(r.sums)
            found[r.fold] = merge(found[r.fold], s) if r.fold in found else s
        return found

    def _measure(self) -> None:
        sizes = self._pass(dict.fromkeys(self.folds), _sizes, _merge_sizes)
        if len(sizes) < len(self.folds) or any(s[0] > 0 or not 0 < s[3] < s[1] for s in sizes.values()):
            return
        k = self.width
        means = {f: np.where(s[4 + k:4 + 2 * k] == -s[4 + 2 * k:], s[4 + k:4 + 2 * k], s[4:4 + k] / s[1]) for f, s in sizes.items()}
        squares = self._pass(means, _squares)
        for f, (_, weight, weight2, positive, *_) in sizes.items():
            free = weight - weight2 / weight
            std = np.sqrt(np.maximum(squares[f] / free, 0.0)) if free > 0 else np.zeros(k)
            self.scales[f] = Scale(means[f], np.divide(1.0, std, out=np.zeros(k), where=std > 0), weight, float(np.log(positive / (weight - positive))))
        self.small = (self.blocks.agg(F.sum(F.octet_length("block"))).first()[0] or 0) <= ONE_TASK
        self.usable = True

    def fit(self, jobs: Sequence[tuple[int, dict, Sequence[int]]]) -> list[dict[int, np.ndarray]]:
        """For each (fold, parameters by name, iteration limits): coefficients and, last, intercept at each limit."""
        todo, k = [], self.width
        for fold, params, limits in jobs:
            value = lambda name: params.get(name, self.last.getOrDefault(name))  # noqa: B023, E731
            unit = np.ones(k) if value("standardization") else self.scales[fold].inverse
            reg, mix = value("regParam"), value("elasticNetParam")
            todo.append(Job(fold, np.append(np.zeros(k), self.scales[fold].start), list(limits), value("tol"),
                            np.append(mix * reg * unit, 0.0) if mix * reg else None, np.append((1.0 - mix) * reg * unit * unit, 0.0)))
        if self.small:
            scales, width = self.scales, k
            task = lambda b: _in_one_task(b, width, todo, scales)
            found = [{} for _ in todo]
            for r in self.blocks.coalesce(1).mapInArrow(task, "job int, at int, point binary").collect():
                found[r.job][r.at] = np.frombuffer(r.point)
        else:
            found = _iterated(todo, self.scales, lambda turn: self._pass(turn, _losses))
        return [{n: self._plain(job.fold, x) for n, x in f.items()} for job, f in zip(todo, found, strict=True)]

    def _plain(self, fold: int, x: np.ndarray) -> np.ndarray:
        """Coefficients and intercept of the features as they are."""
        s = self.scales[fold]
        c = x[:-1] * s.inverse
        return np.append(c, x[-1] - c @ s.mean)

    def counts(self, points: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
        """Rows of each fold by (label, prediction), in the order 0 0, 0 1, 1 0, 1 1: a column for each model."""
        return {f: s.reshape(4, -1) for f, s in self._pass({f: np.column_stack(p) for f, p in points.items()}, _hits).items()}

    def model(self, fold: int, point: np.ndarray, params: dict | None = None) -> PipelineModel:
        """The fitted pipeline of a fold, as Spark's fit gives it."""
        est = self.last.copy(params or {})
        java = JavaParams._new_java_obj("org.apache.spark.ml.classification.LogisticRegressionModel", est.uid,
                                        _py2java(self.spark.sparkContext, DenseVector(point[:-1])), float(point[-1]))
        last = est._copyValues(LogisticRegressionModel(java))
        return PipelineModel([*(self.common[fold].stages if self.before else []), last])
