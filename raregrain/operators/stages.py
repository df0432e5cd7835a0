"""Selectors and the partial AUC as `pyspark.ml` stages: they go into a `Pipeline`, a `CrossValidator` or a
`TrainValidationSplit`, and are saved and loaded with them. All they learn are numbers per feature, kept as params."""
from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raregrain.functions.columns import doubles
from raregrain.operators.metrics import pauc
from raregrain.operators.select import mrmr
from raregrain.operators.wknn import WeightedKnnSelector


def _param(name: str, doc: str, converter) -> Param:
    return Param(Params._dummy(), name, doc, converter)


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    """Saved as its params alone."""


class PartialAucEvaluator(Evaluator, HasLabelCol, _Saved):
    """Area above a minimum true-positive rate; larger is better. Vectors of probabilities count by their last element.

    Rows without a label or a score are left out; with a single class the area is 0.
    """

    scoreCol = _param("scoreCol", "score or probability column", TypeConverters.toString)
    minTpr = _param("minTpr", "least true-positive rate", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, labelCol: str = "target", scoreCol: str = "probability", minTpr: float = 0.8):
        super().__init__()
        self._setDefault(labelCol="target", scoreCol="probability", minTpr=0.8)
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        name = self.getOrDefault(self.scoreCol)
        score = F.col(name)
        if isinstance(dataset.schema[name].dataType, VectorUDT):
            score = F.element_at(vector_to_array(score), -1)
        rows = dataset.select(F.col(self.getLabelCol()).cast("int").alias("target"), score.cast("double").alias("score")).dropna()
        found = pauc(rows, [], self.getOrDefault(self.minTpr), "value").first()
        return float(found["value"]) if found else 0.0

    def isLargerBetter(self) -> bool:
        return True


class _MrmrParams(HasInputCols, HasLabelCol):
    numFeatures = _param("numFeatures", "columns to keep", TypeConverters.toInt)
    mode = _param("mode", "MID, MIQ or FCQ", TypeConverters.toString)
    pool = _param("pool", "only so many of the most relevant columns are candidates; 0: all", TypeConverters.toInt)


class MrmrStage(Estimator, _MrmrParams, _Saved):
    """Learns which of the input columns to keep (see `select.mrmr`)."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, labelCol: str = "target", numFeatures: int = 10, mode: str = "MIQ", pool: int = 0):
        super().__init__()
        self._setDefault(labelCol="target", numFeatures=10, mode="MIQ", pool=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MrmrStageModel:
        get = self.getOrDefault
        picks = mrmr(dataset, self.getInputCols(), self.getLabelCol(), get(self.mode), get(self.numFeatures), get(self.pool) or None)
        chosen = [r["feature"] for r in picks.orderBy("place").collect()]
        return MrmrStageModel(inputCols=self.getInputCols(), selected=chosen)


class MrmrStageModel(Model, HasInputCols, _Saved):
    """Drops the input columns that were not selected; other columns stay as they are."""

    selected = _param("selected", "kept columns, best first", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, selected: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = set(self.getOrDefault(self.selected))
        return dataset.drop(*[c for c in self.getInputCols() if c not in kept])


class WeightedKnnStage(Estimator, HasInputCol, HasOutputCol, HasLabelCol, _Saved):
    """Learns one weight per component of an array column (see `wknn.WeightedKnnSelector`).

    `settings` are the selector's own arguments by name, `keyCol` names unique rows.
    """

    keyCol = _param("keyCol", "unique key", TypeConverters.toString)
    maxFeatures = _param("maxFeatures", "components to keep at most", TypeConverters.toInt)
    settings = _param("settings", "further arguments of the selector", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, inputCol: str = "vec", outputCol: str = "selected", labelCol: str = "target", keyCol: str = "key", maxFeatures: int = 10,
                 settings: dict | None = None):
        super().__init__()
        self._setDefault(inputCol="vec", outputCol="selected", labelCol="target", keyCol="key", maxFeatures=10, settings={})
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> WeightedKnnStageModel:
        get = self.getOrDefault
        selector = WeightedKnnSelector(get(self.maxFeatures), key=get(self.keyCol), vec=self.getInputCol(), target=self.getLabelCol(), **get(self.settings))
        selector.fit(dataset.select(get(self.keyCol), self.getInputCol(), self.getLabelCol()))
        indices, factors = selector.kept()
        size = len(selector.weights)
        return WeightedKnnStageModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), indices=indices, factors=factors,
                                     means=selector.mean or [0.0] * size, deviations=selector.std or [1.0] * size)


class WeightedKnnStageModel(Model, HasInputCol, HasOutputCol, _Saved):
    """Kept components, standardised and weighed, as a new array column."""

    indices = _param("indices", "kept components, heaviest first", TypeConverters.toListInt)
    factors = _param("factors", "what each kept component is multiplied by", TypeConverters.toListFloat)
    means = _param("means", "mean of every component", TypeConverters.toListFloat)
    deviations = _param("deviations", "deviation of every component", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "vec", outputCol: str = "selected", indices: list[int] | None = None, factors: list[float] | None = None,
                 means: list[float] | None = None, deviations: list[float] | None = None):
        super().__init__()
        self._setDefault(inputCol="vec", outputCol="selected")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        at = self.getOrDefault(self.indices)
        mean, std = (np.asarray(self.getOrDefault(p))[at] for p in (self.means, self.deviations))
        places = F.array(*[F.lit(i) for i in at]).cast("array<int>")
        shift, by, times = doubles(mean.tolist()), doubles(std.tolist()), doubles(self.getOrDefault(self.factors))
        vec = F.col(self.getInputCol())
        return dataset.withColumn(self.getOutputCol(), F.transform(places, lambda i, k: (F.get(vec, i) - F.get(shift, k)) / F.get(by, k) * F.get(times, k)))
