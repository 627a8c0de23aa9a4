"""Shared pieces for the models written here as Spark ML estimators.

Models whose fit is a closed form (naive Bayes, discriminant analysis, dummy
baselines, one-feature least squares) are Spark ML ``Estimator``s: ``_fit``
runs one distributed aggregate and keeps the (small, bounded by classes x
features) parameters as Params, so they persist with ``DefaultParamsWriter``
and plug into ``Pipeline``; ``_transform`` is pure column expressions over
``vector_to_array(features)`` -- no UDF, no join, whole-stage codegen.

Classifier outputs follow Spark ML: ``rawPrediction`` and ``probability``
vectors and a ``prediction`` that is the index of the class in sorted order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasPredictionCol,
                                     HasProbabilityCol, HasRawPredictionCol, HasWeightCol)
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReader, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def features_array(df: DataFrame, features: str) -> Column:
    """The numbers of a vector column: plain expressions where the preprocessor left them beside it."""
    plain = f"{features}__x"
    return F.col(plain) if plain in df.columns else vector_to_array(F.col(features))


class HasModelData(Params):
    """Fitted parameters as one JSON-friendly list (persisted with the model)."""
    modelData = Param(Params._dummy(), "modelData", "fitted parameters", typeConverter=TypeConverters.toList)

    def getModelData(self):
        return self.getOrDefault(self.modelData)


class BaseEstimator(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol,
                    DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._set(**self._input_kwargs)

    def _weight(self) -> Column:
        if self.isDefined(self.weightCol) and self.getOrDefault(self.weightCol):
            return F.col(self.getWeightCol()).cast("double")
        return F.lit(1.0)

    def _features(self) -> Column:
        return vector_to_array(F.col(self.getFeaturesCol()))


class BaseModel(Model, HasFeaturesCol, HasPredictionCol, HasModelData,
                DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._set(**self._input_kwargs)

    def _features(self) -> Column:
        return vector_to_array(F.col(self.getFeaturesCol()))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often (or in whichever lambda) the body names it."""
    return F.transform(F.array(value), body)[0]


class BaseClassifierModel(BaseModel, HasProbabilityCol, HasRawPredictionCol):
    def _emit(self, df: DataFrame, scores: Sequence[Column] | Column, classes: Sequence[float],
              log_space: bool = True) -> DataFrame:
        """Append rawPrediction, probability, prediction from per-class scores (columns, or one array).

        ``log_space``: scores are log-likelihoods (probability by a stable
        softmax); otherwise they are already probabilities.
        """
        raw = scores if isinstance(scores, Column) else F.array(*scores)

        def shares(r: Column) -> Column:
            if not log_space:
                return r
            return bind(F.array_max(r), lambda top: bind(F.transform(r, lambda s: F.exp(s - top)), lambda ex: bind(
                F.aggregate(ex, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(ex, lambda v: v / total))))

        both = bind(raw, lambda r: F.struct(r.alias("raw"), shares(r).alias("prob")))
        out = df.withColumn("__scores", both)
        out = (out.withColumn(self.getRawPredictionCol(), array_to_vector(F.col("__scores.raw")))
                  .withColumn(self.getProbabilityCol(), array_to_vector(F.col("__scores.prob"))).drop("__scores"))
        # prediction: the class at the arg-max of the stored probability
        labels = F.array(*[F.lit(float(c)) for c in classes])
        best = bind(vector_to_array(F.col(self.getProbabilityCol())), lambda p: F.element_at(
            labels, F.array_position(p, F.array_max(p)).cast("int")))
        return out.withColumn(self.getPredictionCol(), best)


# --- models made of other models -----------------------------------------------------------

class _SubModelWriter(MLWriter):
    """Parameters as any stage, and every part with its own writer in a folder beside them."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        parts = self.instance.subModels
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc, extraMetadata={"subModels": len(parts)})
        for i, part in enumerate(parts):
            part.write().save(f"{path}/subModels/{i}")


class _SubModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.subModels = [DefaultParamsReader.loadParamsInstance(f"{path}/subModels/{i}", self.sc)
                           for i in range(metadata["subModels"])]
        return model


class HasSubModels:
    """Mixin of a fitted model whose ``subModels`` are saved and loaded with it."""

    subModels: list = []

    def with_parts(self, parts: list):
        self.subModels = list(parts)
        return self

    def write(self) -> MLWriter:
        return _SubModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SubModelReader(cls)

    def copy(self, extra=None):
        return super().copy(extra).with_parts(self.subModels)
