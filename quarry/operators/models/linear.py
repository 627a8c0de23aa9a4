"""Least squares (R1, R3) in closed form, and cross-validation by sufficient statistics.

For one feature the fit is the ``regr_slope``/``regr_intercept`` aggregate.
Cross-validating it needs no per-fold refit: one pass computes the per-fold
sums (n, Sx, Sy, Sxx, Sxy); each fold's training model is the total minus
that fold, and a second pass scores every row against its fold's model
(k rows, broadcast).  Two scans for any k instead of 2k.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_line(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """R1 with one feature: ``slope, intercept`` (per ``by`` group)."""
    return df.groupBy(*(by or [])).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                                       F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def ridge_line(df: DataFrame, x: str, y: str, alpha: float) -> DataFrame:
    """R3 with one feature and intercept: slope = Sxy_c / (Sxx_c + alpha) on central moments."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("cxy"))
    slope = F.col("cxy") * F.col("n") / (F.col("vx") * F.col("n") + F.lit(alpha))
    return s.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def predict_line(df: DataFrame, model: DataFrame, x: str, out: str = "prediction",
                 on: list[str] | None = None) -> DataFrame:
    """Apply a one-feature line; ``model`` is tiny (one row per ``on`` group)."""
    if on:
        return (df.join(model, on)
                  .withColumn(out, F.col("intercept") + F.col("slope") * F.col(x))
                  .drop("slope", "intercept"))
    slope = model.select("slope").scalar()
    intercept = model.select("intercept").scalar()
    return df.withColumn(out, intercept + slope * F.col(x))


def line_fold_models(df: DataFrame, x: str, y: str, fold: str = "fold") -> DataFrame:
    """Per-fold training models from one pass of sufficient statistics."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # sums about the overall means keep their digits
    mx, my = d.select(F.avg(x)).scalar(), d.select(F.avg(y)).scalar()
    d = d.select(fold, (F.col(x) - mx).alias("x"), (F.col(y) - my).alias("y"))
    per = d.groupBy(fold).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"),
                              F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
                              F.sum(F.col("x") * F.col("y")).alias("sxy"))
    from pyspark.sql import Window
    whole = Window.partitionBy()
    tr = per.select(fold, *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in ["n", "sx", "sy", "sxx", "sxy"]])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return tr.select(fold, slope.alias("slope"),
                     ((F.col("sy") - slope * F.col("sx")) / F.col("n") + my - slope * mx).alias("intercept"))


# --- penalised least squares on Spark ML (R2-R4) ------------------------------------------

import numpy as np  # noqa: E402
from pyspark.ml.linalg import Vectors  # noqa: E402
from pyspark.ml.param import Param, Params, TypeConverters  # noqa: E402
from pyspark.ml.regression import LinearRegression  # noqa: E402

from .base import BaseEstimator  # noqa: E402


MOMENT_FEATURES = 16    # most features whose products are SQL sums


class PenalisedLinearRegression(BaseEstimator):
    """1/(2n) sum r^2 + l1 ||w||_1 + l2/2 ||w||^2, solved by Spark's LinearRegression.

    The solver needs no more of the rows than their weight, means and products:
    where the features are few and plain columns, these come from SQL sums, and
    Spark's solver is given a few rows that have the same ones.

    Spark standardises the label internally and divides the L2 part of its
    penalty by the label's std (glmnet convention); the L1 part is unchanged.
    So regParam = l1 + l2 * std(y) and elasticNetParam = l1 / regParam give
    exactly the requested penalties.
    """
    l1 = Param(Params._dummy(), "l1", "L1 penalty per row", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "L2 penalty per row", TypeConverters.toFloat)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None,
                 l1=0.0, l2=0.0):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, l1=l1, l2=l2)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        w, y = self._weight(), F.col(self.getLabelCol()).cast("double")
        plain = f"{self.getFeaturesCol()}__x"
        if plain in df.columns:
            d = (df.select(F.size(plain)).first() or [0])[0]
            if 0 < d <= MOMENT_FEATURES:
                return self._solved(*self._alike(df, d))
        s = df.agg(F.sum(w).alias("sw"), F.sum(w * y).alias("swy")).first()
        mean = F.lit(s["swy"] / s["sw"])
        # the population deviation, as in Spark's normal-equation solver (up to 4096 features)
        std = math.sqrt(df.agg(F.sum(w * (y - mean) * (y - mean))).first()[0] / s["sw"])
        return self._solved(df, std)

    def _alike(self, df: DataFrame, d: int) -> tuple[DataFrame, float]:
        """(rows, deviation of y): 2 (d + 1) rows of the weight, the means and the products that the rows of ``df`` have."""
        w, y = self._weight(), F.col(self.getLabelCol()).cast("double")
        x = F.col(f"{self.getFeaturesCol()}__x")
        rows = df.select(w.alias("w"), *[x[j].alias(f"v{j}") for j in range(d)], y.alias(f"v{d}"))
        v = [F.col(f"v{j}") for j in range(d + 1)]
        n, *sums = rows.agg(F.sum("w"), *[F.sum(F.col("w") * c) for c in v]).first()
        mean = np.array(sums) / n
        about = rows.select("w", *[(c - F.lit(float(m))).alias(f"v{j}") for j, (c, m) in enumerate(zip(v, mean))])
        pairs = [(i, j) for i in range(d + 1) for j in range(i + 1)]
        products = np.zeros((d + 1, d + 1))
        for (i, j), s in zip(pairs, about.agg(*[F.sum(F.col("w") * v[i] * v[j]) for i, j in pairs]).first()):
            products[i, j] = products[j, i] = s / n
        # points on either side of the mean along the axes of the scatter
        scale = np.sqrt(np.maximum(np.diag(products), 0.0))
        unit = np.where(scale > 0, scale, 1.0)
        size, axes = np.linalg.eigh(products / np.outer(unit, unit))
        steps = (axes * np.sqrt(np.maximum(size, 0.0) * (d + 1))).T * scale
        points = np.concatenate([mean + steps, mean - steps])
        names = [self.getFeaturesCol(), self.getLabelCol()]
        weighted = self.isDefined(self.weightCol) and self.getOrDefault(self.weightCol)
        out = df.sparkSession.createDataFrame(
            [(Vectors.dense(p[:d]), float(p[d]), *([float(n / len(points))] if weighted else [])) for p in points],
            names + ([self.getWeightCol()] if weighted else []))
        return out.coalesce(1), float(scale[d])

    def _solved(self, df: DataFrame, std: float):
        l1, l2 = self.getOrDefault(self.l1), self.getOrDefault(self.l2)
        lam = l1 + l2 * (std if std > 0 else 1.0)
        kw = dict(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                  predictionCol=self.getPredictionCol(), regParam=lam,
                  elasticNetParam=(l1 / lam) if lam > 0 else 0.0, standardization=False)
        if self.isDefined(self.weightCol) and self.getOrDefault(self.weightCol):
            kw["weightCol"] = self.getWeightCol()
        return LinearRegression(**kw).fit(df)
