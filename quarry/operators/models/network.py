"""Classifier network (K13): softmax cross-entropy with an L2 penalty and row weights.

The training rows are packed once into blocks (sparse text rows stay sparse) and
persisted.  Every objective evaluation is one pass in which a task adds up loss
and gradient of its blocks; the sums are reduced on the executors, and the
driver steps L-BFGS on a parameter vector whose size is bounded by the model
(features x hidden units + hidden units x classes).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseClassifierModel, BaseEstimator
from .blocks import Rows, measured, scored, sum_over, training_blocks
from .iterative import lbfgs


class Layers:
    """Shapes of the flat parameter vector: d x h weights, h biases, h x k weights, k biases."""

    def __init__(self, d: int, h: int, k: int):
        self.d, self.h, self.k = d, h, k
        self.ends = np.cumsum([d * h, h, h * k, k])

    def split(self, theta: np.ndarray):
        a, b, c, e = np.split(theta, self.ends[:-1])
        return a.reshape(self.d, self.h), b, c.reshape(self.h, self.k), e

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.RandomState(seed)
        one, two = math.sqrt(6.0 / (self.d + self.h)), math.sqrt(6.0 / (self.h + self.k))
        return np.concatenate([rng.uniform(-one, one, self.d * self.h), np.zeros(self.h),
                               rng.uniform(-two, two, self.h * self.k), np.zeros(self.k)])

    def loss(self, theta: np.ndarray, X: Rows, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted cross-entropy of the rows and its gradient (no penalty)."""
        W1, b1, W2, b2 = self.split(theta)
        Z = X @ W1 + b1
        H = np.maximum(Z, 0.0)
        S = H @ W2 + b2
        S -= S.max(axis=1, keepdims=True)
        log_sum = np.log(np.exp(S).sum(axis=1))
        at = (np.arange(len(y)), y.astype(int))
        f = float((w * (log_sum - S[at])).sum())
        R = np.exp(S - log_sum[:, None])
        R[at] -= 1.0
        R *= w[:, None]
        dH = (R @ W2.T) * (Z > 0)
        return f, np.concatenate([X.back(dH).ravel(), dH.sum(0), (H.T @ R).ravel(), R.sum(0)])

    def penalty(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the squared length of the weights (biases are free) and its gradient."""
        g = theta.copy()
        g[self.ends[0]:self.ends[1]] = 0.0
        g[self.ends[2]:] = 0.0
        return 0.5 * float(g @ g), g


class SoftmaxNetwork(BaseEstimator):
    """One hidden ReLU layer, softmax output, penalty ``alpha``, weighted rows, full-batch L-BFGS.

    Minimises (sum of w x cross-entropy + alpha / 2 x squared weights) / sum of w,
    so that a row of weight 2 counts like the row twice.
    """
    alpha = Param(Params._dummy(), "alpha", "L2 penalty", TypeConverters.toFloat)
    hidden = Param(Params._dummy(), "hidden", "hidden units", TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "classes", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "steps", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None,
                 alpha=1e-4, hidden=10, numClasses=2, maxIter=100, seed=42):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, alpha=alpha,
                  hidden=hidden, numClasses=numClasses, maxIter=maxIter, seed=seed)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        blocks = training_blocks(df, self.getFeaturesCol(), self.getLabelCol(), self._weight()) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        d, tasks = measured(blocks)
        if d is None:
            blocks.unpersist()
            raise ValueError("no labelled training rows")
        layers = Layers(d, self.getOrDefault(self.hidden), max(self.getOrDefault(self.numClasses), 2))
        alpha = self.getOrDefault(self.alpha)

        def fg(theta):
            f, g, n = sum_over(blocks, theta, layers.loss, tasks)
            p, gp = layers.penalty(theta)
            return (f + alpha * p) / n, (g + alpha * gp) / n

        theta = lbfgs(fg, layers.start(self.getOrDefault(self.seed)), max_iter=self.getOrDefault(self.maxIter))
        blocks.unpersist()
        return SoftmaxNetworkModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                   modelData=[theta.tolist(), layers.d, layers.h, layers.k])


class SoftmaxNetworkModel(BaseClassifierModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        theta, d, h, k = self.getModelData()
        W1, b1, W2, b2 = Layers(d, h, k).split(np.asarray(theta))

        scores = scored(self.getFeaturesCol(), lambda X: np.maximum(X @ W1 + b1, 0.0) @ W2 + b2)
        return self._emit(df, scores, list(range(k)))
