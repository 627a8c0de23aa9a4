"""Passive-aggressive regression (R5) that doesn't depend on how rows are partitioned.

Equal rows are merged first (their weights add up: a run of updates by one row
is one update of the summed aggressiveness).  Rows are dealt to blocks by a hash
of what they hold, ordered by that hash inside a block and dealt to lanes by
position.  Every lane is a sequence of updates from the epoch's start; a task
advances all lanes of a block together, one row each a step.  The lanes' results
are averaged by the weight of their rows.  The numbers of blocks and lanes follow
from the rows alone; a table of up to ``LANE_ROWS`` rows is one sequence.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseEstimator
from .iterative import LinearModel, _reduce_vectors

LANES = 16                      # sequences in a block, on average, at most
LANE_ROWS = 8192                # rows of a sequence, at most
BLOCK_VALUES = 1 << 22          # numbers of features in a block, on average, at most
EPSILON = 0.1                   # errors up to here cause no update


def lane_pass(theta: np.ndarray, X: np.ndarray, y: np.ndarray, c: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, weight) of each lane after one pass of PA-I updates over a block's rows in order.

    Row i belongs to lane i % lanes; ``theta`` ends with the intercept; ``c``
    limits a row's step.
    """
    n = len(y)
    T = np.tile(theta, (lanes, 1))
    size = (X * X).sum(axis=1) + 1.0
    for i in range(0, n, lanes):
        at = slice(i, min(i + lanes, n))
        rows, live = X[at], T[:min(lanes, n - i)]
        r = y[at] - (rows * live[:, :-1]).sum(axis=1) - live[:, -1]
        step = np.sign(r) * np.minimum(c[at], np.maximum(np.abs(r) - EPSILON, 0.0) / size[at])
        live[:, :-1] += step[:, None] * rows
        live[:, -1] += step
    return T, np.bincount(np.arange(n) % lanes, weights=c, minlength=lanes)


class PassiveAggressiveRegressor(BaseEstimator):
    """PA-I updates (epsilon 0.1), five epochs; a row's weight scales its C, weight 2 is the row twice.

    Rows without a label or with a weight of zero take no part.
    """
    C = Param(Params._dummy(), "C", "aggressiveness", TypeConverters.toFloat)
    epochs = Param(Params._dummy(), "epochs", "passes", TypeConverters.toInt)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None, C=1.0,
                 epochs=5):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, C=C, epochs=epochs)
        if weightCol:
            self._set(weightCol=weightCol)

    def blocks(self, df: DataFrame) -> DataFrame:
        """(d, x, y, w): each block's rows in their order, as bytes of float64 arrays."""
        rows = (df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
                          F.col(self.getLabelCol()).cast("double").alias("y"), self._weight().alias("w"))
                  .where(F.col("y").isNotNull() & (F.col("w") > 0))
                  .groupBy("x", "y").agg(F.sum("w").alias("w"))
                  .withColumn("h", F.xxhash64("x", "y")).persist(StorageLevel.MEMORY_AND_DISK))
        n, d = rows.agg(F.count("y"), F.max(F.size("x"))).first()
        if not n:
            rows.unpersist()
            raise ValueError("no labelled training rows")
        size = max(1, min(LANES * LANE_ROWS, BLOCK_VALUES // (d + 1)))
        count = -(-n // size)

        def pack(pdf):
            import pandas as pd
            order = sorted(range(len(pdf)), key=lambda i: (pdf["h"].iat[i], pdf["y"].iat[i], tuple(pdf["x"].iat[i])))
            pdf = pdf.iloc[order]
            return pd.DataFrame({"d": [d], "x": [np.stack(pdf["x"].to_numpy()).astype(float).tobytes()],
                                 "y": [pdf["y"].to_numpy(float).tobytes()], "w": [pdf["w"].to_numpy(float).tobytes()]})

        # a second hash deals rows to blocks, so that a block's order is free of it
        packed = (rows.withColumn("b", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(count)))
                      .groupBy("b").applyInPandas(pack, "d int, x binary, y binary, w binary")
                      .persist(StorageLevel.MEMORY_AND_DISK))
        packed.count()
        rows.unpersist()
        return packed

    def _fit(self, df: DataFrame):
        packed = self.blocks(df)
        d = packed.select("d").first()[0]
        C, sc = self.getOrDefault(self.C), packed.sparkSession.sparkContext
        theta = np.zeros(d + 1)
        for _ in range(self.getOrDefault(self.epochs)):
            shared = sc.broadcast(theta)

            def part(batches):
                import pandas as pd
                total, weight = np.zeros(d + 1), 0.0
                for b in batches:
                    for x, y, w in b[["x", "y", "w"]].itertuples(index=False):
                        w = np.frombuffer(w)
                        T, c = lane_pass(shared.value, np.frombuffer(x).reshape(-1, d), np.frombuffer(y), C * w,
                                         -(-len(w) // LANE_ROWS))
                        total, weight = total + c @ T, weight + c.sum()
                if weight:
                    yield pd.DataFrame({"t": [total], "n": [weight]})

            weight, total = _reduce_vectors(packed.mapInPandas(part, "t array<double>, n double"), "t", d + 1, extra=("n",))
            shared.unpersist()
            theta = total / weight
        packed.unpersist()
        return LinearModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                           modelData=[theta[:-1].tolist(), float(theta[-1])])
