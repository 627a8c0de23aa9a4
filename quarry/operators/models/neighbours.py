"""k-nearest-neighbour models (R14, K12) on the exact pivot index.

A fitted model is the index of its training rows, kept in the shared
checkpoint folder and saved as parquet with the model; scoring joins each
different feature vector's neighbours back to the rows.  Votes are column
expressions.  Equal distances go to the smaller key (``keyCols``; without it to
the smaller label and vector hash).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from ...sources.paging import numbered
from ..pivot_index import Cells, PivotIndex, point_key
from .base import BaseClassifierModel, BaseEstimator, BaseModel

WEIGHTINGS = ("uniform", "distance")


class _NeighbourParams(Params):
    nNeighbors = Param(Params._dummy(), "nNeighbors", "neighbours that vote", TypeConverters.toInt)
    maxNeighbors = Param(Params._dummy(), "maxNeighbors", "most neighbours that the index is kept for", TypeConverters.toInt)
    weighting = Param(Params._dummy(), "weighting", "uniform | distance", TypeConverters.toString)
    keyCols = Param(Params._dummy(), "keyCols", "columns that order equal distances", TypeConverters.toListString)
    numClasses = Param(Params._dummy(), "numClasses", "classes", TypeConverters.toInt)


class _IndexWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        cells = self.instance.index.cells
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc, extraMetadata={
            "pivots": cells.pivots.tolist(), "dim": int(cells.pivots.shape[1]),
            # an empty part has infinite bounds, which JSON lacks
            "parts": [[float(v) if np.isfinite(v) else str(v) for v in row] for row in cells.parts]})
        self.instance.index.points.write.parquet(f"{path}/points")


class _IndexReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        pivots = np.array(metadata["pivots"], dtype=np.float64).reshape(-1, metadata["dim"])
        parts = np.array([[float(v) for v in row] for row in metadata["parts"]], dtype=np.float64).reshape(-1, 4)
        model.index = PivotIndex(self.sparkSession.read.parquet(f"{path}/points"), Cells(pivots, parts))
        return model


class _Neighbours(_NeighbourParams):
    """What both fitted models share."""

    index: PivotIndex

    def write(self) -> MLWriter:
        return _IndexWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _IndexReader(cls)

    def copy(self, extra=None):
        out = super().copy(extra)
        out.index = self.index
        return out

    def voting(self, k: int, weighting: str = "uniform"):
        """The same index with another number of neighbours, up to ``maxNeighbors``, or another weighting."""
        if not 1 <= k <= self.getOrDefault(self.maxNeighbors):
            raise ValueError(f"the index was built for up to {self.getOrDefault(self.maxNeighbors)} neighbours")
        if weighting not in WEIGHTINGS:
            raise ValueError(f"unknown weighting {weighting!r}")
        out = self.copy()
        out._set(nNeighbors=k, weighting=weighting)
        return out

    def searched(self, df: DataFrame) -> DataFrame:
        """The rows with ``__near``, the ``maxNeighbors`` nearest: models of the same index then vote without a search."""
        return self._found(df, self.getOrDefault(self.maxNeighbors))

    def _found(self, df: DataFrame, k: int) -> DataFrame:
        found = self.index.nearest(df.select(self._features().alias("x")), k)
        keyed = df.withColumn("__x", self._features()).withColumn("__q", point_key("__x")).drop("__x")
        return keyed.join(found.select(F.col("q").alias("__q"), F.col("near").alias("__near")), "__q", "left").drop("__q")

    def _votes(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """The rows with ``__near``, and that column as (y, weight) votes."""
        k = self.getOrDefault(self.nNeighbors)
        out = df.withColumn("__near", F.slice("__near", 1, k)) if "__near" in df.columns else self._found(df, k)
        near = F.col("__near")
        if self.getOrDefault(self.weighting) == "uniform":
            return out, F.transform(near, lambda p: F.struct(p["y"].alias("y"), F.lit(1.0).alias("w")))
        # a neighbour at distance 0 leaves no vote to the others
        touches = F.exists(near, lambda p: p["d"] == 0)
        weight = lambda p: F.when(touches, (p["d"] == 0).cast("double")).otherwise(1.0 / p["d"])
        return out, F.transform(near, lambda p: F.struct(p["y"].alias("y"), weight(p).alias("w")))


def _sum(votes: Column, term) -> Column:
    return F.aggregate(votes, F.lit(0.0), lambda a, v: a + term(v))


class KNeighborsRegressionModel(_Neighbours, BaseModel):
    """Mean of the neighbours' targets by weight; null where the training table was empty."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out, votes = self._votes(df)
        out = out.withColumn("__votes", votes)
        v = F.col("__votes")
        value = _sum(v, lambda p: p["w"] * p["y"]) / _sum(v, lambda p: p["w"])
        return out.withColumn(self.getPredictionCol(), value).drop("__near", "__votes")


class KNeighborsClassificationModel(_Neighbours, BaseClassifierModel):
    """Share of the neighbours' votes by class; equal shares go to the first class."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out, votes = self._votes(df)
        out = out.withColumn("__votes", votes)
        v = F.col("__votes")
        total = _sum(v, lambda p: p["w"])
        classes = [float(c) for c in range(self.getOrDefault(self.numClasses))]
        shares = [_sum(v, lambda p, c=c: F.when(p["y"] == c, p["w"]).otherwise(0.0)) / total for c in classes]
        return self._emit(out, shares, classes, log_space=False).drop("__near", "__votes")


class _KNeighbors(BaseEstimator, _NeighbourParams):
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", nNeighbors=5,
                 weighting="uniform", keyCols=(), numClasses=2, maxNeighbors=None):
        super().__init__()
        if weighting not in WEIGHTINGS:
            raise ValueError(f"unknown weighting {weighting!r}")
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, nNeighbors=nNeighbors,
                  weighting=weighting, keyCols=list(keyCols), numClasses=numClasses, maxNeighbors=maxNeighbors or nNeighbors)

    def _fit(self, df: DataFrame):
        keys = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(self.getOrDefault(self.keyCols))]
        rows = df.select(*keys, self._features().alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        order = [f"__k{i}" for i in range(len(keys))] + ["y", "__h"]
        ranked = numbered(rows.withColumn("__h", F.xxhash64("x")), order)
        index = PivotIndex.build(cut_lineage(ranked.select("x", F.col("#").alias("tie"), "y")),
                                 self.getOrDefault(self.maxNeighbors))
        model = self._model(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        for name in ("nNeighbors", "maxNeighbors", "weighting", "keyCols", "numClasses"):
            model._set(**{name: self.getOrDefault(getattr(self, name))})
        model.index = index
        return model


class KNeighborsRegressor(_KNeighbors):
    """K nearest rows by Euclidean distance, their targets averaged, uniformly or by 1 / distance."""
    _model = KNeighborsRegressionModel


class KNeighborsClassifier(_KNeighbors):
    """K nearest rows by Euclidean distance, their classes voting, uniformly or by 1 / distance."""
    _model = KNeighborsClassificationModel
