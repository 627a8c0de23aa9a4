"""Models with no Spark ML counterpart, as distributed iterative estimators.

* ``MLPRegressor`` (R15): full-batch objective and gradient summed over blocks of
  rows on the executors (NumPy inside the task), L-BFGS steps on the driver over
  a parameter vector bounded by the model size.
* ``AdaBoostRegressor`` (R12, loss linear/square/exponential, weighted median),
  each tree (:mod:`.trees`) on a weighted bootstrap whose draws hash row key and round,
  and ``AdaBoostClassifier`` (K10, SAMME), a loop of weighted Spark trees; the
  boosting weights are a column updated by expressions each round, with the
  lineage cut in the shared checkpoint folder every few rounds.
* ``ProbabilisticLinearSVC`` (K4, K5): linear machines of all classes and folds
  fitted together, with a Platt (logistic) calibration on out-of-fold margins; ``OneVsRestProbabilistic`` turns any
  binary probabilistic classifier into a multi-class one with probabilities.

Training frames are persisted for the duration of a fit and released after.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from ..jobs import side_by_side
from .base import BaseClassifierModel, BaseEstimator, BaseModel, HasSubModels
from .blocks import measured, scored, sum_over, training_blocks
from .trees import GROUP_TASK, GROUPING, SAMPLE_ROWS, Rules, SquaredError, TreeRegressionModel, grow

ROUNDING = 0.1                  # width of the hinge's rounded corner, in margins
TOLERANCE = 1e-7                # relative step of a machine's objective that ends its fit
CLASSES_AT_ONCE = 4             # one-vs-rest fits whose jobs run together
BOOST_BINS = 32                 # bins of a feature in AdaBoost's trees for regression, as in Spark's

# ---------------------------------------------------------------------------------------
# distributed objective / gradient + L-BFGS on the driver
# ---------------------------------------------------------------------------------------


def _reduce_vectors(partial: DataFrame, vec: str, size: int, extra: tuple = ()):
    """Sum per-partition vectors on the executors (index -> value, ``groupBy``), then
    collect one vector: the driver never receives one row per partition."""
    scal = [F.struct(F.lit(-1 - i).alias("k"), F.col(c).alias("v")) for i, c in enumerate(extra)]
    long = partial.select(F.inline(F.concat(
        F.array(*scal) if scal else F.array().cast("array<struct<k:int,v:double>>"),
        F.transform(F.col(vec), lambda v, i: F.struct(i.alias("k"), v.alias("v"))))))
    rows = long.groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    scalars = [0.0] * len(extra)
    for r in rows:
        if r["k"] >= 0:
            out[r["k"]] = r["v"]
        else:
            scalars[-1 - r["k"]] = r["v"]
    return (scalars[0], out, *scalars[1:]) if extra else out


def lbfgs(fg, x0: np.ndarray, max_iter: int = 100, m: int = 8, tol: float = 1e-10) -> np.ndarray:
    """Limited-memory BFGS with Armijo backtracking (driver side, small vectors)."""
    x = x0.copy()
    f, g = fg(x)
    g_tol = 1e-8 * max(1.0, float(np.linalg.norm(g)))
    s_hist, y_hist = [], []
    for _ in range(max_iter):
        q = g.copy()
        alphas = []
        for s, yv in reversed(list(zip(s_hist, y_hist))):
            a = s.dot(q) / yv.dot(s)
            alphas.append(a)
            q -= a * yv
        if s_hist:
            q *= s_hist[-1].dot(y_hist[-1]) / y_hist[-1].dot(y_hist[-1])
        for (s, yv), a in zip(zip(s_hist, y_hist), reversed(alphas)):
            b = yv.dot(q) / yv.dot(s)
            q += s * (a - b)
        d = -q
        if g.dot(d) >= 0 or not s_hist:
            # first step (or a bad direction): steepest descent scaled to unit length
            d = -g / max(1.0, float(np.linalg.norm(g)))
        step = 1.0
        while True:
            xn = x + step * d
            fn, gn = fg(xn)
            if fn <= f + 1e-4 * step * g.dot(d) or step < 1e-10:
                break
            step *= 0.5
        s, yv = xn - x, gn - g
        if yv.dot(s) > 1e-12:
            s_hist.append(s)
            y_hist.append(yv)
            if len(s_hist) > m:
                s_hist.pop(0)
                y_hist.pop(0)
        converged = abs(f - fn) <= tol * max(1.0, abs(f)) and len(s_hist) > 1
        x, f, g = xn, fn, gn
        if converged or np.linalg.norm(g) < g_tol:
            break
    return x


class LinearModel(BaseModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        coef, intercept = self.getModelData()
        x = self._features()
        dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in coef]), lambda a, b: a * b),
                          F.lit(float(intercept)), lambda a, b: a + b)
        return df.withColumn(self.getPredictionCol(), dot)

    @property
    def coefficients(self):
        return self.getModelData()[0]


def _merged(rows: DataFrame, features: str, my: float, sy: float) -> tuple[DataFrame, float]:
    """(features, mean standardised y, summed w) of rows with equal features, persisted, and the squares that no output can undo."""
    w, y = F.col("w"), (F.col("y") - F.lit(my)) / F.lit(sy)
    sums = rows.groupBy(vector_to_array(features).alias("x")).agg(
        F.sum("w").alias("w"), F.sum(w * y).alias("s1"), F.sum(w * y * y).alias("s2")).where(w != 0)
    held = sums.select(array_to_vector("x").alias(features), (F.col("s1") / w).alias("y"), "w",
                       (F.col("s2") - F.col("s1") * F.col("s1") / w).alias("spare")).persist(StorageLevel.MEMORY_AND_DISK)
    return held, float(held.agg(F.sum("spare")).first()[0] or 0.0)


class MLPRegressor(BaseEstimator):
    """One hidden ReLU layer, L2 penalty alpha, full-batch L-BFGS (target standardised)."""
    alpha = Param(Params._dummy(), "alpha", "L2 penalty", TypeConverters.toFloat)
    hidden = Param(Params._dummy(), "hidden", "hidden units", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None,
                 alpha=1e-4, hidden=10, seed=42):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol,
                  alpha=alpha, hidden=hidden, seed=seed)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        rows = df.select(self.getFeaturesCol(), F.col(self.getLabelCol()).cast("double").alias("y"),
                         self._weight().alias("w")).where(F.col("y").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
        st = rows.agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"), F.count("y").alias("rows"),
                      F.approx_count_distinct(F.xxhash64(vector_to_array(self.getFeaturesCol()))).alias("kinds")).first()
        if not st["n"]:
            rows.unpersist()
            raise ValueError("no labelled training rows")
        n, my, h = st["n"], st["my"], self.getOrDefault(self.hidden)
        about = F.sum(F.col("w") * (F.col("y") - F.lit(my)) * (F.col("y") - F.lit(my)))
        sy = max(math.sqrt(rows.agg(about).first()[0] / n), 1e-12)
        # rows of equal features have one output: their squared loss is that around their mean target, and a constant
        spare, few = 0.0, st["kinds"] * GROUPING <= st["rows"]
        if few:
            merged, spare = _merged(rows, self.getFeaturesCol(), my, sy)
            used = merged.coalesce(-(-st["kinds"] // GROUP_TASK))
        else:
            used = rows.select(self.getFeaturesCol(), ((F.col("y") - F.lit(my)) / F.lit(sy)).alias("y"), "w")
        data = training_blocks(used, self.getFeaturesCol(), "y", F.col("w")).persist(StorageLevel.MEMORY_AND_DISK)
        d, tasks = measured(data)
        rows.unpersist()
        if few:
            merged.unpersist()
        alpha = self.getOrDefault(self.alpha)
        rng = np.random.RandomState(self.getOrDefault(self.seed))
        lim1, lim2 = math.sqrt(6.0 / (d + h)), math.sqrt(6.0 / (h + 1))
        theta0 = np.concatenate([rng.uniform(-lim1, lim1, d * h), np.zeros(h), rng.uniform(-lim2, lim2, h), [0.0]])

        def unpack(th):
            W1 = th[:d * h].reshape(d, h)
            b1 = th[d * h:d * h + h]
            W2 = th[d * h + h:d * h + 2 * h]
            return W1, b1, W2, th[-1]

        def batch(th, X, y, w):
            W1, b1, W2, b2 = unpack(th)
            f, g = 0.5 * spare * float(w.sum()) / n, np.zeros(len(th))
            for at, x in X.slices():
                Z = x @ W1 + b1
                H = np.maximum(Z, 0.0)
                r = H @ W2 + b2 - y[at]
                wr = w[at] * r
                f += 0.5 * float((wr * r).sum())
                dH = np.outer(wr, W2) * (Z > 0)
                g += np.concatenate([x.back(dH).ravel(), dH.sum(0), H.T @ wr, [wr.sum()]])
            return f, g

        def fg(th):
            f, g, _ = sum_over(data, th, batch, tasks)
            W1, _, W2, _ = unpack(th)
            f = f / n + alpha / (2.0 * n) * (np.sum(W1 * W1) + np.sum(W2 * W2))
            g = g / n
            g[:d * h] += alpha / n * W1.ravel()
            g[d * h + h:d * h + 2 * h] += alpha / n * W2
            return f, g

        theta = lbfgs(fg, theta0, max_iter=100)
        data.unpersist()
        return MLPRegressionModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                  modelData=[theta.tolist(), d, h, my, sy])


class MLPRegressionModel(BaseModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        theta, d, h, my, sy = self.getModelData()
        th = np.asarray(theta)
        W1 = th[:d * h].reshape(d, h)
        b1 = th[d * h:d * h + h]
        W2 = th[d * h + h:d * h + 2 * h]
        b2 = th[-1]
        out = scored(self.getFeaturesCol(), lambda X: np.maximum(X @ W1 + b1, 0.0) @ W2[:, None] + b2)[0]
        return df.withColumn(self.getPredictionCol(), out * float(sy) + float(my))


# ---------------------------------------------------------------------------------------
# boosting loops over Spark trees
# ---------------------------------------------------------------------------------------

class _Frames:
    """The boosting frame of the current round; the one before is released when its successor exists."""

    def __init__(self):
        self.held = []

    def keep(self, df: DataFrame, cut: bool) -> DataFrame:
        df = (cut_lineage(df) if cut else df).persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        self.release()
        self.held.append(df)
        return df

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held = []


class _Ensemble:
    """Sub-models applied in turn; each adds one named prediction column."""

    def __init__(self, models, cols):
        self.models, self.cols = models, cols

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        out = df
        for m, c in zip(self.models, self.cols):
            m = m.copy()
            m.setPredictionCol(c)
            extra = []
            for p in ("probabilityCol", "rawPredictionCol"):
                if m.hasParam(p):
                    m._set(**{p: f"{c}_{p}"})
                    extra.append(f"{c}_{p}")
            out = m.transform(out).drop(*extra)
        return out


def _mean_importances(models, weights) -> DenseVector:
    """Importances of the parts, averaged by their weights in the ensemble."""
    parts = np.array([m.featureImportances.toArray() for m in models])
    return DenseVector(np.average(parts, axis=0, weights=weights))


def uniform(seed: int, *cols) -> Column:
    """A number in (0, 1) from a hash of ``seed`` and the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + 0.5) / F.lit(float(1 << 53))


def poisson_draw(rate: Column, seed: int, *cols) -> Column:
    """A Poisson number of mean ``rate``, the same for the same seed and columns wherever the row lies.

    Up to a rate of 16 by inversion, term by term up to 80 (beyond lies less than
    2e-26 of the mass); above, a normal number with the skewness corrected, rounded.
    The hashes are columns; a batch of rows is inverted at once, only as many terms
    as its numbers need.
    """
    @F.pandas_udf("double")
    def draw(rate, one, two):
        import pandas as pd
        rate, one, two = (v.to_numpy(dtype=float) for v in (rate, one, two))
        small = np.minimum(rate, 16.0)
        p = np.exp(-small)
        upto, out = p.copy(), np.zeros(len(rate))
        live = np.flatnonzero((rate <= 16) & (upto < one))
        for i in range(1, 81):
            if not len(live):
                break
            out[live] += 1
            p[live] = p[live] * small[live] / i
            upto[live] += p[live]
            live = live[upto[live] < one[live]]
        far = np.flatnonzero(~(rate <= 16))
        z = np.sqrt(-2.0 * np.log(one[far])) * np.cos(2.0 * math.pi * two[far])
        out[far] = np.floor(rate[far] + np.sqrt(rate[far]) * z + (z * z - 1.0) / 6.0 + 0.5)
        return pd.Series(np.minimum(out, float(1 << 63)))

    drawn = draw(rate.cast("double"), uniform(seed, *cols), uniform(seed + (1 << 32), *cols))
    return F.when(rate.isNotNull(), F.coalesce(drawn, F.lit(0.0)))


def value_splits(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Candidate thresholds of a feature, by the rule of Spark's trees: all midpoints of up to ``bins`` values, else strides of equal weight."""
    kinds, at = np.unique(values[weights > 0], return_inverse=True)
    held = np.bincount(at, weights=weights[weights > 0], minlength=len(kinds))
    between = (kinds[:-1] + kinds[1:]) / 2
    if len(between) < bins:
        return between
    stride = held.sum() / bins
    upto, goal, out = np.cumsum(held), stride, []
    for i in range(1, len(kinds)):
        if abs(upto[i - 1] - goal) < abs(upto[i] - goal):
            out.append(between[i - 1])
            goal += stride
    return np.array(out)


class AdaBoostRegressor(BaseEstimator):
    """AdaBoost.R2 over depth-3 trees, each fitted to a weighted bootstrap of the rows.

    A row's copies in a round are a Poisson number of mean n x its boosting
    weight, drawn from a hash of row key and round (``keyCols``; without them,
    of what the row holds), so a repartitioned table gives the same bootstrap.
    """
    keyCols = Param(Params._dummy(), "keyCols", "columns that tell rows apart", TypeConverters.toListString)
    loss = Param(Params._dummy(), "loss", "linear | square | exponential", TypeConverters.toString)
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", TypeConverters.toFloat)
    nEstimators = Param(Params._dummy(), "nEstimators", "rounds", TypeConverters.toInt)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None,
                 loss="linear", learningRate=1.0, nEstimators=50, keyCols=()):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, loss=loss,
                  learningRate=learningRate, nEstimators=nEstimators, keyCols=list(keyCols))
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        lr, loss = self.getOrDefault(self.learningRate), self.getOrDefault(self.loss)
        label = self.getLabelCol()
        key = self.getOrDefault(self.keyCols)
        held = [F.col(c) for c in key] or [F.col(label), vector_to_array(F.col(self.getFeaturesCol()))]
        cur = df.select(self._features().alias("x"), F.col(label).cast("double").alias("y"), self._weight().alias("aw"),
                        F.xxhash64(*held).alias("rid"))
        cores = df.sparkSession.sparkContext.defaultParallelism
        if cur.rdd.getNumPartitions() < cores:
            cur = cur.repartition(cores)
        models, weights, frames = [], [], _Frames()
        cur = frames.keep(cur, cut=False)
        n, tot, dim = cur.agg(F.count(F.lit(1)), F.sum("aw"), F.max(F.size("x"))).first()
        # thresholds come from a sample that a hash draws, the whole of a smaller table
        few = F.lit(True) if n <= SAMPLE_ROWS else F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(1 << 30)) < int(SAMPLE_ROWS / n * (1 << 30))
        cur = cur.withColumn("aw", F.col("aw") / tot)
        aw, err = F.col("aw"), F.abs(F.col("y") - F.col("p"))

        def target(batch, tree):
            return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))

        for m in range(self.getOrDefault(self.nEstimators)):
            # the round's draws are kept with its weights: a tree reads its rows in every level
            cur = frames.keep(cur.withColumn("w", poisson_draw(aw * n, 42 + m, F.col("rid"))), cut=m % 5 == 4)
            some = cur.where(few).select("x", "w").toArrow()
            x = some.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            drawn = some.column("w").to_numpy()
            cuts = [value_splits(x[:, j], drawn, min(BOOST_BINS, n)) for j in range(dim)]
            (tree,), gains = grow(cur, 1, dim, target, SquaredError(), Rules(depth=3), cuts)
            model = TreeRegressionModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                        modelData=[[tree.listed()], gains.tolist(), 0])
            scored = cur.withColumn("p", tree.column(F.col("x")))
            max_err, once, twice = scored.agg(F.max(F.when(aw > 0, err)), F.sum(aw * err), F.sum(aw * err * err)).first()
            if not max_err:
                models.append(model)
                weights.append(1.0)
                break
            e = err / max_err
            e = e * e if loss == "square" else (1.0 - F.exp(-e) if loss == "exponential" else e)
            if loss == "exponential":
                est_err = scored.agg(F.sum(aw * e)).first()[0]
            else:
                est_err = twice / max_err / max_err if loss == "square" else once / max_err
            if est_err >= 0.5:
                if not models:
                    models.append(model)
                    weights.append(1.0)
                break
            beta = est_err / (1.0 - est_err)
            models.append(model)
            weights.append(lr * math.log(1.0 / beta) if beta > 0 else 1.0)
            cur = scored.withColumn("aw", aw * F.pow(F.lit(beta), (1.0 - e) * lr)).select("x", "y", "aw", "rid")
            s = cur.agg(F.sum("aw")).first()[0]
            cur = cur.withColumn("aw", aw / s)
        frames.release()
        return AdaBoostRegressionModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                       modelData=[weights]).with_parts(models)


class AdaBoostRegressionModel(HasSubModels, BaseModel):
    """Weighted median of the trees' predictions."""

    @property
    def featureImportances(self):
        return _mean_importances(self.subModels, self.getModelData()[0])

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = self.getModelData()[0]
        cols = [f"__t{i}" for i in range(len(self.subModels))]
        if all(isinstance(m, TreeRegressionModel) for m in self.subModels):
            out = df.withColumn("__x", self._features())
            out = out.withColumns({c: m.trees[0].column(F.col("__x")) for c, m in zip(cols, self.subModels)}).drop("__x")
        else:       # saved with Spark's own trees
            out = _Ensemble(self.subModels, cols).apply(df, keep=[])
        pairs = F.array_sort(F.array(*[F.struct(F.col(c).alias("p"), F.lit(float(w)).alias("w"))
                                       for c, w in zip(cols, weights)]))
        half = 0.5 * sum(weights)
        start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("p"))

        def step(s, t):
            upto = s["upto"] + t["w"]
            return F.struct(upto.alias("upto"), F.when(s["p"].isNull() & (upto >= half), t["p"]).otherwise(s["p"]).alias("p"))

        return out.withColumn(self.getPredictionCol(), F.aggregate(pairs, start, step)["p"]).drop(*cols)


class AdaBoostClassifier(BaseEstimator):
    """SAMME over stumps; probabilities exp(decision / (K - 1)), normalised."""
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage", TypeConverters.toFloat)
    nEstimators = Param(Params._dummy(), "nEstimators", "rounds", TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "classes", TypeConverters.toInt)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None,
                 learningRate=1.0, nEstimators=50, numClasses=2):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol,
                  learningRate=learningRate, nEstimators=nEstimators, numClasses=numClasses)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        lr, K = self.getOrDefault(self.learningRate), max(self.getOrDefault(self.numClasses), 2)
        label = self.getLabelCol()
        cur = df.select(self.getFeaturesCol(), label, self._weight().alias("__aw"))
        models, alphas, frames = [], [], _Frames()
        for m in range(self.getOrDefault(self.nEstimators)):
            cur = frames.keep(cur, cut=m % 5 == 0)
            stump = DecisionTreeClassifier(featuresCol=self.getFeaturesCol(), labelCol=label, weightCol="__aw",
                                           maxDepth=1, seed=42 + m).fit(cur)
            scored = stump.transform(cur).withColumn("__bad", (F.col("prediction") != F.col(label)).cast("double"))
            r = scored.agg((F.sum(F.col("__aw") * F.col("__bad")) / F.sum("__aw")).alias("e")).first()
            err = r["e"]
            if err <= 0:
                models.append(stump)
                alphas.append(1.0)
                break
            if err >= 1.0 - 1.0 / K:
                if not models:
                    models.append(stump)
                    alphas.append(1.0)
                break
            a = lr * (math.log((1.0 - err) / err) + math.log(K - 1.0))
            models.append(stump)
            alphas.append(a)
            # w * exp(a * bad), rescaled by exp(-a) so large learning rates cannot overflow
            cur = scored.withColumn("__aw", F.col("__aw") * F.exp(F.lit(a) * (F.col("__bad") - 1.0))) \
                        .select(self.getFeaturesCol(), label, "__aw")
            total = cur.agg(F.sum("__aw")).first()[0]
            cur = cur.withColumn("__aw", F.col("__aw") / total)
        frames.release()
        return AdaBoostClassificationModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                           modelData=[alphas, K]).with_parts(models)


class AdaBoostClassificationModel(HasSubModels, BaseClassifierModel):
    @property
    def featureImportances(self):
        return _mean_importances(self.subModels, self.getModelData()[0])

    def _transform(self, df: DataFrame) -> DataFrame:
        alphas, K = self.getModelData()
        cols = [f"__s{i}" for i in range(len(self.subModels))]
        out = _Ensemble(self.subModels, cols).apply(df, keep=[])
        total = sum(alphas)
        scores = []
        for k in range(K):
            dec = sum(((F.col(c) == float(k)).cast("double") * float(a) for c, a in zip(cols, alphas)), F.lit(0.0))
            scores.append(dec / total / (K - 1))
        return self._emit(out, scores, list(range(K))).drop(*cols)


class ProbabilisticLinearSVC(BaseEstimator):
    """K4: hinge-loss linear SVM per class, Platt-calibrated margins, normalised.

    The margins that the calibration learns from are out of fold: rows are dealt
    to ``folds`` by a hash of what they hold (equal rows share a fold), and each
    fold is scored by a machine fitted without it.  The machine that predicts is
    fitted on all rows.  A fold without which one class is missing is scored by
    that machine.

    All machines (classes x (folds + 1)) are columns of one matrix, and every
    pass over the rows moves all of them.  The hinge is rounded within
    ``ROUNDING`` of its corner, so that L-BFGS has a gradient everywhere;
    calibration targets are Platt's, (n + 1) / (n + 2) and 1 / (n + 2).
    """
    folds = Param(Params._dummy(), "folds", "folds of the calibration", TypeConverters.toInt)
    regParam = Param(Params._dummy(), "regParam", "L2 penalty per row", TypeConverters.toFloat)
    numClasses = Param(Params._dummy(), "numClasses", "classes", TypeConverters.toInt)

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", weightCol=None,
                 regParam=0.0, numClasses=2, folds=3):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol,
                  regParam=regParam, numClasses=numClasses, folds=folds)
        if weightCol:
            self._set(weightCol=weightCol)

    def _fit(self, df: DataFrame):
        K, folds = max(self.getOrDefault(self.numClasses), 2), self.getOrDefault(self.folds)
        label = self.getLabelCol()
        content = F.xxhash64(vector_to_array(F.col(self.getFeaturesCol())), F.col(label))
        # a block's y holds class and fold in one number: class + K x fold
        data = df.select(self.getFeaturesCol(), self._weight().alias("__pw"),
                         (F.col(label) + K * F.pmod(content, F.lit(folds))).alias("__y"))
        blocks = training_blocks(data, self.getFeaturesCol(), "__y", F.col("__pw")).persist(StorageLevel.MEMORY_AND_DISK)
        d, tasks = measured(blocks)
        if d is None:
            blocks.unpersist()
            raise ValueError("no labelled training rows")

        def tally(_, rows, y, w):
            return 0.0, np.bincount(y.astype(int), weights=w, minlength=K * folds)

        held = sum_over(blocks, np.zeros(K * folds), tally, tasks)[1].reshape(folds, K)
        targets = [1] if K == 2 else list(range(K))
        machines = [(k, -1) for k in targets] + [(k, f) for k in targets for f in self._splits(held, k)]
        classes, left_out = np.array(machines).T
        weight = np.array([held.sum() - (held[f].sum() if f >= 0 else 0.0) for f in left_out])
        reg, M = self.getOrDefault(self.regParam), len(machines)

        def hinge(theta, X, y, w):
            W = theta.reshape(d + 1, M)
            fold, side = (y // K).astype(int), np.where((y % K)[:, None] == classes, 1.0, -1.0)
            z = 1.0 - side * (X @ W[:d] + W[d])
            share = w[:, None] * (fold[:, None] != left_out) / weight
            curve = np.clip(z / ROUNDING, 0.0, 1.0)
            R = -side * curve * share
            loss = np.where(z < ROUNDING, 0.5 * curve * curve * ROUNDING, z - ROUNDING / 2)
            return float((loss * share).sum()), np.concatenate([X.back(R), R.sum(0)[None]]).ravel()

        def machine_fg(theta):
            f, g, _ = sum_over(blocks, theta, hinge, tasks)
            W = theta.reshape(d + 1, M)[:d]
            g[:d * M] += reg * W.ravel()
            return f + reg / 2 * float((W * W).sum()), g

        W = lbfgs(machine_fg, np.zeros((d + 1) * M), tol=TOLERANCE).reshape(d + 1, M)
        # the machine that never saw fold f, by (fold, class)
        unseen = np.array([[machines.index((k, f)) if (k, f) in machines else j for j, k in enumerate(targets)]
                           for f in range(folds)])
        positive = np.array([held[:, k].sum() for k in targets])
        yes, no = (positive + 1) / (positive + 2), 1 / (held.sum() - positive + 2)
        goal = np.array(targets)

        def platt(theta, X, y, w):
            a, c = theta.reshape(2, -1)
            m = np.take_along_axis(X @ W[:d] + W[d], unseen[(y // K).astype(int)], axis=1)
            s = a * m + c
            t = np.where((y % K)[:, None] == goal, yes, no)
            r = w[:, None] * (1.0 / (1.0 + np.exp(-np.clip(s, -500, 500))) - t)
            return float((w[:, None] * (np.logaddexp(0.0, s) - t * s)).sum()), np.concatenate([(r * m).sum(0), r.sum(0)])

        def platt_fg(theta):
            f, g, n = sum_over(blocks, theta, platt, tasks)
            return f / n, g / n

        a, c = lbfgs(platt_fg, np.zeros(2 * len(targets)), tol=TOLERANCE).reshape(2, -1)
        blocks.unpersist()
        pairs = [[W[:d, j].tolist(), float(W[d, j]), float(a[j]), float(c[j])] for j in range(len(targets))]
        return PlattModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), modelData=[K, pairs])

    @staticmethod
    def _splits(held: np.ndarray, k: int) -> list[int]:
        """Folds without which both sides of class ``k`` keep weight."""
        rest = held.sum(0) - held
        return [f for f in range(len(held)) if rest[f, k] > 0 and rest[f].sum() - rest[f, k] > 0]


class PlattModel(BaseClassifierModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        K, pairs = self.getModelData()
        W, b, a, c = (np.array(part) for part in zip(*pairs))

        def shares(X):
            p = 1.0 / (1.0 + np.exp(-np.clip(a * (X @ W.T + b) + c, -500, 500)))
            return np.hstack([1.0 - p, p]) if K == 2 else p / p.sum(axis=1, keepdims=True)

        return self._emit(df, scored(self.getFeaturesCol(), shares), list(range(K)), log_space=False)


class OneVsRestProbabilistic(BaseEstimator):
    """One binary probabilistic classifier per class; probabilities normalised."""
    numClasses = Param(Params._dummy(), "numClasses", "classes", TypeConverters.toInt)

    def __init__(self, classifier=None, featuresCol="features", labelCol="label", predictionCol="prediction",
                 numClasses=2):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol, numClasses=numClasses)
        self._classifier = classifier

    def _fit(self, df: DataFrame):
        K = self.getOrDefault(self.numClasses)
        data = df.drop(f"{self.getFeaturesCol()}__x").persist(StorageLevel.MEMORY_AND_DISK)

        def one(k):
            clf = self._classifier.copy()
            clf.setLabelCol("__y")
            return clf.fit(data.withColumn("__y", (F.col(self.getLabelCol()) == float(k)).cast("double")))

        models = list(side_by_side(df.sparkSession, [lambda k=k: one(k) for k in range(K)], CLASSES_AT_ONCE))
        data.unpersist()
        return OneVsRestProbModel(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                                  modelData=[K]).with_parts(models)


class OneVsRestProbModel(HasSubModels, BaseClassifierModel):
    @property
    def featureImportances(self):
        return _mean_importances(self.subModels, [1.0] * len(self.subModels))

    def _transform(self, df: DataFrame) -> DataFrame:
        K = self.getModelData()[0]
        out = df
        cols = []
        for k, m in enumerate(self.subModels):
            m = m.copy()
            m.setPredictionCol(f"__ovr_p{k}").setProbabilityCol(f"__ovr_q{k}").setRawPredictionCol(f"__ovr_r{k}")
            out = m.transform(out)
            out = out.withColumn(f"__ovr_{k}", vector_to_array(f"__ovr_q{k}")[1]) \
                     .drop(f"__ovr_p{k}", f"__ovr_q{k}", f"__ovr_r{k}")
            cols.append(f"__ovr_{k}")
        total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
        return self._emit(out, [F.col(c) / total for c in cols], list(range(K)), log_space=False).drop(*cols)
