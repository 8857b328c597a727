"""Fitted models as column expressions.

``compile_model`` reads a fitted ``PipelineModel`` stage by stage and keeps
what its last stage computes as numbers: a linear form over the inputs
(logistic regression, and the linear SVM with its logistic fit on the margin),
or weighted trees (boosted trees).  ``Compiled.probability()`` is then a plain
column: no ML vectors, no ``transform``, and only the columns that the model
uses are read.  ``Compiled.table`` is the model as a table, one row per
coefficient or tree node.

The inputs are the columns that the pipeline starts from: scalar columns, with
NULL and NaN replaced as the imputer does, or the places of one vector column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LinearSVCModel, LogisticRegressionModel
from pyspark.ml.feature import ImputerModel, StandardScalerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurewatch.ml.median import ExactMedianImputerModel

Linear = tuple[dict[int, float], float]        # coefficients by input, constant


@dataclass
class Tree:
    """Nodes in pre-order: the input and threshold of a split (``input`` -1: a leaf) and where its right side begins."""
    inputs: list[int] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    values: list[float] = field(default_factory=list)

    def used(self) -> set[int]:
        return {i for i in self.inputs if i >= 0}

    def column(self, x: Callable[[int], Column], node: int = 0) -> Column:
        if self.inputs[node] < 0:
            return F.lit(self.values[node])
        return F.when(x(self.inputs[node]) <= self.thresholds[node], self.column(x, node + 1)).otherwise(self.column(x, self.right[node]))

    def evaluate(self, x: Callable[[int], np.ndarray], rows: int) -> np.ndarray:
        """The tree's value of each of ``rows`` rows; ``x(i)`` gives input i of all rows."""
        out = np.empty(rows)
        todo = [(0, np.arange(rows))]
        while todo:
            node, at = todo.pop()
            if self.inputs[node] < 0:
                out[at] = self.values[node]
            elif len(at):
                low = x(self.inputs[node])[at] <= self.thresholds[node]
                todo += [(node + 1, at[low]), (self.right[node], at[~low])]
        return out


@dataclass
class Compiled:
    """A binary classifier: ``names`` and ``inputs`` (columns) it starts from, and its numbers."""
    names: list[str]
    inputs: list[Column]
    coefficients: list[float] | None = None
    intercept: float = 0.0
    trees: list[tuple[float, Tree]] | None = None

    def margin(self, x: Callable[[int], Column] | None = None) -> Column:
        """Of the model's own inputs, or of others: ``x(i)`` gives input i."""
        x = x or self.inputs.__getitem__
        if self.trees is not None:
            return reduce(lambda a, b: a + b, [F.lit(w) * t.column(x) for w, t in self.trees], F.lit(0.0))
        return reduce(lambda a, b: a + b, [F.lit(c) * x(i) for i, c in enumerate(self.coefficients) if c], F.lit(0.0)) + self.intercept

    def probability_of(self, margin: Column) -> Column:
        """Probability of class 1, in the steps that Spark ML takes."""
        return 1.0 - 1.0 / (1.0 + F.exp((2.0 if self.trees is not None else 1.0) * margin))

    def probability(self) -> Column:
        return self.probability_of(self.margin())

    def table(self, spark: SparkSession) -> DataFrame:
        """Linear: (feature, coefficient), the constant as ``(intercept)``.  Trees: one row per node."""
        if self.trees is None:
            rows = [*zip(self.names, map(float, self.coefficients), strict=True), ("(intercept)", float(self.intercept))]
            return spark.createDataFrame(rows, "feature string, coefficient double")
        rows = [(k, w, n, self.names[i] if i >= 0 else None, c if i >= 0 else None, r if i >= 0 else None, v if i < 0 else None)
                for k, (w, t) in enumerate(self.trees) for n, (i, c, r, v) in enumerate(zip(t.inputs, t.thresholds, t.right, t.values, strict=True))]
        return spark.createDataFrame(rows, "tree int, weight double, node int, feature string, threshold double, right_node int, value double")

    def importances(self) -> list[tuple[str, float]] | None:
        """|coefficients| by their sum, greatest first (ties by name); None for trees."""
        if self.trees is not None:
            return None
        total = sum(map(abs, self.coefficients)) or 1.0
        return sorted(((n, abs(c) / total) for n, c in zip(self.names, self.coefficients, strict=True)), key=lambda t: (-t[1], t[0]))


def linear_model(names: Sequence[str], inputs: Sequence[Column], table: DataFrame) -> Compiled:
    """A linear model from its table (feature, coefficient); the table has one row per feature."""
    rows = {r.feature: r.coefficient for r in table.select("feature", "coefficient").collect()}
    return Compiled(list(names), list(inputs), [rows.get(n) or 0.0 for n in names], rows.get("(intercept)") or 0.0)


_NODE = re.compile(r"^(If|Else) \(feature (\d+) (<=|>) (\S+)\)$|^Predict: (\S+)$")


def _trees(model: GBTClassificationModel) -> list[tuple[float, Tree]]:
    """The trees from the model's printed form, which states thresholds and values in full."""
    out: list[tuple[float, Tree]] = []
    weights = list(model.treeWeights)
    splits: list[int] = []
    for line in map(str.strip, model.toDebugString.splitlines()):
        if re.match(r"^Tree \d+ \(weight .*\):$", line):
            out.append((float(weights[len(out)]), Tree()))
            splits = []
        elif found := _NODE.match(line):
            kind, feature, sign, value, leaf = found.groups()
            tree = out[-1][1]
            if kind == "Else":
                tree.right[splits.pop()] = len(tree.inputs)
                continue
            if kind == "If":
                splits.append(len(tree.inputs))
            tree.inputs.append(-1 if leaf else int(feature))
            tree.thresholds.append(math.nan if leaf else float(value))
            tree.values.append(float(leaf) if leaf else math.nan)
            tree.right.append(-1)
        elif line.startswith(("If", "Else")):
            raise ValueError(f"only splits of numbers can be compiled: {line}")
    return out


def _sum(forms: Sequence[Linear], weights: Sequence[float], constant: float) -> Linear:
    out: dict[int, float] = {}
    for (coefficients, own), w in zip(forms, weights, strict=True):
        constant += w * own
        for i, c in coefficients.items():
            out[i] = out.get(i, 0.0) + w * c
    return out, constant


def compile_model(model: PipelineModel, names: Sequence[str] | None = None) -> Compiled:
    """The model as expressions.  ``names`` name the places of a vector column.  A stage that is neither linear nor a
    boosted tree raises ValueError: such a model is scored by ``transform``."""
    found: list[str] = []
    inputs: list[Column] = []
    scalars: dict[str, Linear] = {}
    vectors: dict[str, list[Linear]] = {}

    def scalar(name: str) -> Linear:
        if name not in scalars:
            scalars[name] = ({len(inputs): 1.0}, 0.0)
            found.append(name)
            inputs.append(F.col(f"`{name}`").cast("double"))
        return scalars[name]

    def vector(name: str, size: int) -> list[Linear]:
        if name not in vectors:
            own = vector_to_array(F.col(f"`{name}`"))
            vectors[name] = [({len(inputs) + i: 1.0}, 0.0) for i in range(size)]
            found.extend(names or [f"{name}[{i}]" for i in range(size)])
            inputs.extend(own[i] for i in range(size))
        return vectors[name]

    for stage in model.stages:
        if isinstance(stage, ImputerModel | ExactMedianImputerModel):
            own = stage.getMedians() if isinstance(stage, ExactMedianImputerModel) else [float(stage.surrogateDF.first()[c]) for c in stage.getInputCols()]
            for name, out, median in zip(stage.getInputCols(), stage.getOutputCols(), own, strict=True):
                value = F.col(f"`{name}`").cast("double")
                scalars[out] = ({len(inputs): 1.0}, 0.0)
                found.append(name)
                inputs.append(F.when(value.isNull() | F.isnan(value), F.lit(median)).otherwise(value))
        elif isinstance(stage, VectorAssembler):
            vectors[stage.getOutputCol()] = [f for c in stage.getInputCols() for f in (vectors[c] if c in vectors else [scalar(c)])]
        elif isinstance(stage, StandardScalerModel):
            std, mean = stage.std.toArray(), stage.mean.toArray()
            own = vector(stage.getInputCol(), len(std))
            scale = [1.0 / s if s else 0.0 for s in std] if stage.getWithStd() else [1.0] * len(std)
            shift = mean if stage.getWithMean() else np.zeros(len(std))
            vectors[stage.getOutputCol()] = [_sum([f], [k], -k * float(m)) for f, k, m in zip(own, scale, shift, strict=True)]
        elif isinstance(stage, VectorSlicer):
            vectors[stage.getOutputCol()] = [vectors[stage.getInputCol()][i] for i in stage.getIndices()]
        elif isinstance(stage, LinearSVCModel | LogisticRegressionModel):
            own = vector(stage.getFeaturesCol(), stage.numFeatures)
            last = _sum(own, [float(c) for c in stage.coefficients.toArray()], float(stage.intercept))
            vectors[stage.getRawPredictionCol()] = [_sum([last], [-1.0], 0.0), last]
        elif isinstance(stage, GBTClassificationModel):
            own = vector(stage.getFeaturesCol(), stage.numFeatures)
            place = [next(iter(f)) if list(f.values()) == [1.0] and not c else None for f, c in own]
            trees = _trees(stage)
            if any(place[i] is None for _, t in trees for i in t.used()):
                raise ValueError("trees over changed inputs")
            for _, t in trees:
                t.inputs = [place[i] if i >= 0 else -1 for i in t.inputs]
            return Compiled(found, inputs, trees=trees)
        else:
            raise ValueError(f"no expression for {type(stage).__name__}")
    if not isinstance(model.stages[-1], LogisticRegressionModel):
        raise ValueError(f"no probability from {type(model.stages[-1]).__name__}")
    coefficients, constant = last
    return Compiled(found, inputs, [coefficients.get(i, 0.0) for i in range(len(inputs))], constant)
