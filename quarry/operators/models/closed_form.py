"""Closed-form models: naive Bayes (K16), discriminant analysis (K17, K18) and
the benchmark dummies (R16, K19).

Fitting is one aggregate of per-class moments.  Diagonal moments come from
Spark's ``Summarizer`` (JVM only, centred); full covariances come from
per-batch NumPy cross-products in ``mapInPandas`` emitted in long form and
summed by ``groupBy`` -- the shuffle carries classes x features^2 numbers per
partition, never rows.  The driver receives one row per class: the model.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BaseClassifierModel, BaseEstimator, BaseModel

NO_VARIANCE = 1e-9              # share of the largest variance up to which a direction has none


def class_moments(df: DataFrame, features_col: str, label: str, weight: Column):
    """(classes, weights, means, population variances): one aggregated vector row per class."""
    rows = (df.select(F.col(label).cast("double").alias("c"), weight.alias("w"), F.col(features_col).alias("x"))
            .groupBy("c").agg(Summarizer.metrics("mean", "variance").summary(F.col("x"), F.col("w")).alias("s"),
                              F.sum("w").alias("w1"), F.sum(F.col("w") * F.col("w")).alias("w2"))
            .select("c", "s.*", "w1", "w2").orderBy("c").collect())
    n = np.array([r["w1"] for r in rows])
    mean = np.array([r["mean"].toArray() for r in rows])
    # the summary divides by n - sum(w^2) / n
    back = (n - np.array([r["w2"] for r in rows]) / n) / n
    var = np.array([r["variance"].toArray() for r in rows]) * np.maximum(back, 0.0)[:, None]
    return [r["c"] for r in rows], n, mean, var


def full_moments(df: DataFrame, features_col: str, label: str, weight: Column):
    """(classes, weights, means, centred scatter matrices), one assembled row per class.

    Sums are taken about the overall mean, so that they keep their digits, in
    NumPy per batch, and added per (class, element) on the executors.
    """
    src = df.select(F.col(label).cast("double").alias("c"), weight.alias("w"), F.col(features_col).alias("f"))
    centre = src.select(Summarizer.mean(F.col("f"), F.col("w")).alias("m")).first()["m"].toArray()
    src = src.select("c", "w", vector_to_array("f").alias("x"))

    def partial(batches):
        import pandas as pd
        acc = {}
        for b in batches:
            if len(b) == 0:
                continue
            X = np.stack(b["x"].to_numpy()) - centre
            w = b["w"].to_numpy(dtype=float)
            for c in np.unique(b["c"].to_numpy()):
                m = b["c"].to_numpy() == c
                Xc, wc = X[m], w[m]
                part = np.concatenate([[wc.sum()], wc @ Xc, ((Xc * wc[:, None]).T @ Xc).ravel()])
                acc[c] = acc.get(c, 0) + part
        for c, v in acc.items():
            yield pd.DataFrame({"c": c, "k": np.arange(len(v)), "v": v})

    sums = src.mapInPandas(partial, "c double, k long, v double").groupBy("c", "k").agg(F.sum("v").alias("v"))
    rows = (sums.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a"))
            .select("c", F.transform("a", lambda e: e["v"]).alias("v")).orderBy("c").collect())
    d = len(centre)
    data = np.array([r["v"] for r in rows])
    n, shift = data[:, 0], data[:, 1:1 + d] / data[:, :1]
    scatter = data[:, 1 + d:].reshape(-1, d, d) - n[:, None, None] * shift[:, :, None] * shift[:, None, :]
    return [r["c"] for r in rows], n, centre + shift, scatter


# --- Gaussian naive Bayes --------------------------------------------------------------

class GaussianNB(BaseEstimator):
    """Per-class means and population variances (+1e-9 x largest variance)."""
    varSmoothing = Param(Params._dummy(), "varSmoothing", "variance smoothing", TypeConverters.toFloat)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 weightCol=None, varSmoothing=1e-9):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol,
                  varSmoothing=varSmoothing)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        classes, n, mean, var = class_moments(df, self.getFeaturesCol(), self.getLabelCol(), self._weight())
        tot_n = n.sum()
        all_mean = (n[:, None] * mean).sum(0) / tot_n
        all_var = (n[:, None] * (var + (mean - all_mean) ** 2)).sum(0) / tot_n
        eps = self.getOrDefault(self.varSmoothing) * float(all_var.max())
        var = np.maximum(var, 0.0) + eps
        prior = n / tot_n
        data = [classes, prior.tolist(), mean.tolist(), var.tolist()]
        return GaussianNBModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                               modelData=data)


class GaussianNBModel(BaseClassifierModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        classes, prior, mean, var = self.getModelData()
        x = self._features()
        # one literal array of classes and one expression over it, however many classes there are
        params = F.array(*[F.struct(
            F.lit(math.log(prior[k]) - 0.5 * sum(math.log(2 * math.pi * v) for v in var[k])).alias("c"),
            F.lit([float(v) for v in mean[k]]).alias("m"), F.lit([float(v) for v in var[k]]).alias("v"))
            for k in range(len(classes))])
        scores = F.transform(params, lambda p: p["c"] - 0.5 * F.aggregate(
            F.zip_with(F.zip_with(x, p["m"], lambda a, b: a - b), p["v"], lambda d, v: d * d / v),
            F.lit(0.0), lambda a, b: a + b))
        return self._emit(df, scores, classes)

    @property
    def classes(self):
        return self.getModelData()[0]


# --- discriminant analysis ---------------------------------------------------------------

def _quad_form(x: Column, mu: np.ndarray, inv: np.ndarray) -> Column:
    """(x - mu)^T inv (x - mu) via a factor of ``inv``, which may be singular, as array higher-order functions."""
    scale = np.sqrt(np.diag(inv))
    scale[scale == 0] = 1.0
    size, axes = np.linalg.eigh(inv / np.outer(scale, scale))
    held = size > 0
    rows = (axes[:, held] * np.sqrt(size[held])).T * scale   # inv = rows^T rows  ->  form = ||rows (x - mu)||^2
    centered = F.zip_with(x, F.array(*[F.lit(float(v)) for v in mu]), lambda a, b: a - b)
    terms = []
    for r in rows:
        dot = F.aggregate(F.zip_with(centered, F.array(*[F.lit(float(v)) for v in r]), lambda a, b: a * b),
                          F.lit(0.0), lambda a, b: a + b)
        terms.append(dot * dot)
    return sum(terms, F.lit(0.0))


class LinearDiscriminant(BaseEstimator):
    """Class means, shared within-class covariance (divided by n - k)."""

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        classes, n, means, scatter = full_moments(df, self.getFeaturesCol(), self.getLabelCol(), self._weight())
        cov = scatter.sum(0) / max(n.sum() - len(classes), 1.0)
        inv = np.linalg.pinv(cov)
        prior = n / n.sum()
        coef = means @ inv
        intercept = -0.5 * np.einsum("kd,kd->k", coef, means) + np.log(prior)
        return LinearDiscriminantModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                       modelData=[classes, coef.tolist(), intercept.tolist()])


class LinearDiscriminantModel(BaseClassifierModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        classes, coef, intercept = self.getModelData()
        x = self._features()
        scores = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in coef[k]]), lambda a, b: a * b),
                              F.lit(float(intercept[k])), lambda a, b: a + b) for k in range(len(classes))]
        return self._emit(df, scores, classes)


class QuadraticDiscriminant(BaseEstimator):
    """One mean and covariance (divided by n_k - 1) per class.

    Directions without variance, such as the sum of a one-hot block, take no
    part: of them a covariance holds only the rounding of its sums.
    """

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        classes, n, means, scatter = full_moments(df, self.getFeaturesCol(), self.getLabelCol(), self._weight())
        prior = n / n.sum()
        # one scale for all classes: no feature's unit decides which directions are held, and determinants compare
        scale = np.sqrt(np.maximum(np.diag(scatter.sum(0)), 0.0) / n.sum())
        scale[scale == 0] = 1.0
        params = []
        for k in range(len(classes)):
            mu = means[k]
            cov = scatter[k] / max(n[k] - 1.0, 1.0)
            size, axes = np.linalg.eigh(cov / np.outer(scale, scale))
            held = size > NO_VARIANCE * max(size.max(), 0.0)
            half = axes[:, held] / np.sqrt(size[held]) / scale[:, None]
            logdet = np.log(size[held]).sum() + 2 * np.log(scale).sum()
            inv = half @ half.T + np.eye(len(mu)) * 1e-12
            params.append([mu.tolist(), inv.tolist(), float(-0.5 * logdet + math.log(prior[k]))])
        return QuadraticDiscriminantModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                          modelData=[classes, params])


class QuadraticDiscriminantModel(BaseClassifierModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        classes, params = self.getModelData()
        x = self._features()
        scores = [F.lit(c) - 0.5 * _quad_form(x, np.array(mu), np.array(inv)) for mu, inv, c in params]
        return self._emit(df, scores, classes)


# --- benchmark dummies --------------------------------------------------------------------

class DummyRegressor(BaseEstimator):
    """Predicts the (weighted) mean of the training target."""

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        w = self._weight()
        mean = df.agg((F.sum(w * F.col(self.getLabelCol())) / F.sum(w)).alias("m")).first()["m"]
        return DummyRegressionModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                    modelData=[float(mean)])


class DummyRegressionModel(BaseModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getPredictionCol(), F.lit(self.getModelData()[0]))


class DummyClassifier(BaseEstimator):
    """Class priors as probabilities; predicts the most frequent class."""

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        counts = (df.groupBy(F.col(self.getLabelCol()).cast("double").alias("c"))
                    .agg(F.sum(self._weight()).alias("n")).collect())
        counts = sorted((r["c"], r["n"]) for r in counts)
        total = sum(n for _, n in counts)
        return DummyClassificationModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                        modelData=[[c for c, _ in counts], [n / total for _, n in counts]])


class DummyClassificationModel(BaseClassifierModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        classes, prior = self.getModelData()
        return self._emit(df, [F.lit(float(p)) for p in prior], classes, log_space=False)
