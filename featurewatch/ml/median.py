"""Exact-median imputation as a Spark ML stage (E11 on the training path).

Spark's ``Imputer`` takes medians from an approximate quantile sketch, which
differ from E11's.  ``ExactMedianImputer`` fits them with the ranked counts of
``exact_percentiles`` (no task holds a column's values) on the rows that the
pipeline is fitted on, and its model is saved and loaded with the pipeline.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurewatch.operators.log_stats import exact_percentiles


def _value(name: str) -> Column:
    """The column as a double, NaN as NULL."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


class ExactMedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces NULL and NaN by the exact (interpolated) median of the rows it is fitted on; a column without any value
    gets 0.  With ``countCol`` a row stands for so many equal ones."""

    countCol = Param(Params._dummy(), "countCol", "number of rows that a row stands for", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExactMedianImputerModel:
        cols, names = self.getInputCols(), [f"c{i}" for i in range(len(self.getInputCols()))]
        count = ["__rows"] if self.isSet("countCol") else []
        values = dataset.select(*[_value(c).alias(n) for c, n in zip(cols, names, strict=True)], *[F.col(self.getOrDefault("countCol")).alias(c) for c in count])
        long = values.unpivot(count, names, "column", "value")
        found = {r.column: r.p_0 for r in exact_percentiles(long, "value", [0.5], groups=["column"], count_col=count[0] if count else None).collect()}  # a row per column
        model = ExactMedianImputerModel(inputCols=cols, outputCols=self.getOutputCols(), medians=[found.get(f"c{i}") or 0.0 for i in range(len(cols))])
        return self._copyValues(model)


class ExactMedianImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "median of each input column", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, medians=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def getMedians(self) -> list[float]:
        return self.getOrDefault(self.medians)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({out: F.coalesce(_value(name), F.lit(m)) for name, out, m in zip(
            self.getInputCols(), self.getOutputCols(), self.getMedians(), strict=True)})
