"""Models fitted in rounds: gradients, weights, order of rows, bootstrap shares."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quarry.operators.models.blocks import Rows
from quarry.operators.models.iterative import AdaBoostRegressor, MLPRegressor, ProbabilisticLinearSVC, poisson_draw
from quarry.operators.models.network import Layers, SoftmaxNetwork
from quarry.operators.models.online import EPSILON, PassiveAggressiveRegressor, lane_pass


def _rows(spark, rows):
    df = spark.createDataFrame(rows, "k long, x array<double>, y double, w double")
    return df.select("k", "y", "w", array_to_vector("x").alias("features")).withColumn("label", F.col("y"))


def _classes(n=240, seed=3):
    rng = np.random.RandomState(seed)
    X = rng.randn(n, 3)
    y = np.argmax(np.stack([X[:, 0], X[:, 1], -X[:, 0] - X[:, 1]], 1), axis=1)
    return [(i, X[i].tolist(), float(y[i]), 1.0 + i % 2) for i in range(n)]


def test_network_gradient_is_the_numeric_one():
    rng = np.random.RandomState(1)
    net = Layers(4, 5, 3)
    theta, X = net.start(0) + 0.1 * rng.randn(net.ends[-1]), rng.randn(30, 4)
    y, w = rng.randint(0, 3, 30).astype(float), rng.rand(30) + 0.5

    def total(t):
        f, g = net.loss(t, Rows(4, None, None, X), y, w)
        p, gp = net.penalty(t)
        return f + 0.7 * p, g + 0.7 * gp

    g = total(theta)[1]
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        assert (total(theta + step)[0] - total(theta - step)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-4, abs=1e-5)


def test_network_weight_two_is_the_row_twice(spark):
    rows = _classes()
    twice = [(k, x, y, 1.0) for k, x, y, w in rows for _ in range(int(w))]
    a = SoftmaxNetwork(weightCol="w", hidden=4, numClasses=3, maxIter=15, alpha=0.1).fit(_rows(spark, rows))
    b = SoftmaxNetwork(hidden=4, numClasses=3, maxIter=15, alpha=0.1).fit(_rows(spark, twice).repartition(5))
    assert np.allclose(a.getModelData()[0], b.getModelData()[0], rtol=1e-5, atol=1e-6)


def test_network_learns_and_alpha_shrinks_it(spark):
    df = _rows(spark, _classes())
    free = SoftmaxNetwork(hidden=6, numClasses=3, alpha=1e-3, maxIter=40).fit(df)
    held = SoftmaxNetwork(hidden=6, numClasses=3, alpha=1e4, maxIter=12).fit(df)
    out = free.transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.95
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in out)
    assert np.abs(held.getModelData()[0][:18]).max() < 0.05 < np.abs(free.getModelData()[0][:18]).max()
    X = np.array([r["features"].toArray() for r in df.limit(5).collect()])
    theta, d, h, k = free.getModelData()
    W1, b1, W2, b2 = Layers(d, h, k).split(np.array(theta))
    s = np.maximum(X @ W1 + b1, 0) @ W2 + b2
    want = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    got = [r["probability"].toArray() for r in free.transform(df.limit(5)).collect()]
    assert np.allclose(got, want)


def test_sparse_rows_multiply_like_dense_ones():
    rng = np.random.RandomState(8)
    X = rng.randn(7, 5) * (rng.rand(7, 5) < 0.4)
    X[2] = 0.0
    X[6] = 0.0
    at = [np.flatnonzero(x) for x in X]
    rows = Rows.of(pd.Series([5] * 7), pd.Series(at), pd.Series([x[i] for x, i in zip(X, at)]))
    W, R = rng.randn(5, 3), rng.randn(7, 2)
    assert rows.n == 7 and np.allclose(rows @ W, X @ W) and np.allclose(rows.back(R), X.T @ R)


@pytest.mark.parametrize("estimator", [SoftmaxNetwork(hidden=4, numClasses=3, maxIter=15, alpha=0.1),
                                       MLPRegressor(hidden=4, alpha=0.1)])
def test_networks_on_sparse_vectors_equal_dense_ones(spark, estimator):
    rows = [(k, [v if abs(v) > 0.7 else 0.0 for v in x], y, w) for k, x, y, w in _classes()]
    dense = _rows(spark, rows)
    sparse = spark.createDataFrame([(k, Vectors.sparse(3, [(i, v) for i, v in enumerate(x) if v]), y) for k, x, y, _ in rows],
                                   ["k", "features", "label"])
    column = "probability" if isinstance(estimator, SoftmaxNetwork) else "prediction"
    one, two = ([r[column] for r in estimator.fit(df).transform(df).orderBy("k").collect()] for df in (dense, sparse))
    near = [np.abs(np.asarray(a) - np.asarray(b)).max() for a, b in zip(one, two)]
    assert len(near) == len(rows) and max(near) < 1e-3


def test_network_without_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        SoftmaxNetwork().fit(_rows(spark, []))


def _line(n=900, seed=5):
    rng = np.random.RandomState(seed)
    X = rng.randn(n, 3)
    y = X @ [2.0, -1.0, 0.5] + 3.0 + 0.05 * rng.randn(n)
    return [(i, X[i].tolist(), float(y[i]), 1.0) for i in range(n)]


def test_lanes_equal_updates_one_by_one():
    rng = np.random.RandomState(2)
    X, y, c = rng.randn(83, 4), rng.randn(83), rng.rand(83)
    lanes = 16
    T, weight = lane_pass(np.zeros(5), X, y, c, lanes)
    for lane in range(lanes):
        th = np.zeros(5)
        for i in range(lane, 83, lanes):
            r = y[i] - X[i] @ th[:4] - th[4]
            if abs(r) > EPSILON:
                step = math.copysign(min(c[i], (abs(r) - EPSILON) / (X[i] @ X[i] + 1)), r)
                th += step * np.append(X[i], 1.0)
        assert np.allclose(T[lane], th) and weight[lane] == pytest.approx(c[lane::lanes].sum())


def test_passive_aggressive_ignores_partitions(spark, monkeypatch):
    monkeypatch.setattr("quarry.operators.models.online.LANE_ROWS", 20)      # several blocks
    df = _rows(spark, _line())
    fits = [PassiveAggressiveRegressor(C=0.5).fit(df.repartition(p)).getModelData() for p in (1, 7, 64)]
    for coef, b in fits:
        assert np.allclose(coef, fits[0][0], rtol=1e-9) and b == pytest.approx(fits[0][1], rel=1e-9)
    assert np.allclose(fits[0][0], [2.0, -1.0, 0.5], atol=0.1) and fits[0][1] == pytest.approx(3.0, abs=0.1)


def test_passive_aggressive_weight_is_repetition(spark):
    rows = _line(100)
    a = PassiveAggressiveRegressor(C=0.01, weightCol="w").fit(_rows(spark, [(k, x, y, 3.0) for k, x, y, _ in rows]))
    b = PassiveAggressiveRegressor(C=0.01).fit(_rows(spark, rows * 3))
    assert np.allclose(a.getModelData()[0], b.getModelData()[0]) and a.getModelData()[1] == pytest.approx(b.getModelData()[1])


@pytest.mark.parametrize("rate", [0.2, 1.0, 7.5, 16.0, 40.0, 1000.0])
def test_poisson_draws_have_their_mean_and_variance(spark, rate):
    n = 40_000
    r = spark.range(n).select(poisson_draw(F.lit(rate), 42, F.col("id")).alias("d")) \
        .agg(F.avg("d"), F.var_pop("d"), F.avg((F.col("d") == 0).cast("double")), F.min("d")).first()
    assert abs(r[0] - rate) < 5 * math.sqrt(rate / n)
    assert abs(r[1] - rate) < 5 * math.sqrt((rate + 2 * rate * rate) / n)
    assert abs(r[2] - math.exp(-rate)) < 5 * math.sqrt(math.exp(-rate) / n) + 1e-9 and r[3] >= 0


def test_draws_follow_key_and_round_alone(spark):
    def draws(df, seed):
        return {r["id"]: r["d"] for r in df.select("id", poisson_draw(F.lit(1.0), seed, F.col("id")).alias("d")).collect()}
    ids = spark.range(2000)
    assert draws(ids, 42) == draws(ids.repartition(9), 42) != draws(ids, 43)


@pytest.mark.parametrize("loss", ["linear", "square", "exponential"])
def test_adaboost_is_the_same_after_repartitioning(spark, loss):
    df = _rows(spark, _line(300))
    fits = [AdaBoostRegressor(loss=loss, nEstimators=4, keyCols=["k"]).fit(df.repartition(p)) for p in (2, 11)]
    assert np.allclose(fits[0].getModelData()[0], fits[1].getModelData()[0])
    a, b = ([r["prediction"] for r in f.transform(df).orderBy("k").collect()] for f in fits)
    assert np.allclose(a, b)
    rows = fits[0].transform(df).select("label", "prediction").collect()
    y = np.array([r["label"] for r in rows])
    assert 1 - np.mean((y - [r["prediction"] for r in rows]) ** 2) / y.var() > 0.7


def test_draws_invert_the_poisson_shares(spark):
    rates = [0.0, 0.3, 1.0, 7.5, 16.0, 40.0, None, float("nan")]
    df = spark.createDataFrame([(i, rates[i % len(rates)]) for i in range(4000)], "k long, rate double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(5), "k"), 11) + 0.5) / F.lit(float(1 << 53))
    for r in df.withColumn("u", u).withColumn("d", poisson_draw(F.col("rate"), 5, F.col("k"))).collect():
        if r["rate"] is None or math.isnan(r["rate"]):
            assert r["d"] == (None if r["rate"] is None else 0)
        elif r["rate"] <= 16:
            d, below = int(r["d"]), lambda k: sum(math.exp(-r["rate"]) * r["rate"] ** i / math.factorial(i) for i in range(k + 1))
            assert below(d) > r["u"] - 1e-12 and (d == 0 or below(d - 1) < r["u"] + 1e-12)
    mean = df.where("rate = 40").agg(F.avg(poisson_draw(F.col("rate"), 5, F.col("k")))).first()[0]
    assert abs(mean - 40) < 2


def test_adaboost_grows_the_trees_of_spark_from_few_passes(spark):
    # rounded numbers: candidates are midpoints of few values for one feature, strides of weight for the other
    from pyspark.ml.regression import DecisionTreeRegressor
    rng = np.random.RandomState(4)
    x = np.stack([rng.randint(0, 9, 900).astype(float), rng.randn(900).round(3)], 1)
    df = _rows(spark, [(i, x[i].tolist(), float(x[i, 0] // 3 + abs(x[i, 1]) + rng.randn() / 9), 1.0) for i in range(900)])
    model = AdaBoostRegressor(nEstimators=3, keyCols=["k"]).fit(df)
    drawn = df.withColumn("w", poisson_draw(F.lit(1.0), 42, F.xxhash64("k"))).where("w > 0")
    tree = DecisionTreeRegressor(weightCol="w", maxDepth=3, seed=42).fit(drawn)
    a, b = ([r["prediction"] for r in m.transform(df).orderBy("k").collect()] for m in (tree, model.subModels[0]))
    assert np.allclose(a, b)
    # a tree grown here: a pass for each level, not Spark's rows made objects and sampled anew in each round
    assert len(model.subModels[0].trees) == 1 and model.subModels[0].trees[0].feature[0] == 0
    part = model.transform(df).orderBy("k").select("prediction").toPandas()["prediction"].to_numpy()
    all_ = np.array([[r["prediction"] for r in m.transform(df).orderBy("k").collect()] for m in model.subModels]).T
    w = np.array(model.getModelData()[0])
    for row, got in zip(all_, part):
        order = np.lexsort((w, row))
        assert got == row[order][np.argmax(np.cumsum(w[order]) >= 0.5 * w.sum())]


def test_regression_network_passes_over_different_rows_only(spark, monkeypatch):
    from quarry.operators.models import iterative as it
    rng = np.random.RandomState(6)
    kinds = rng.randn(40, 2)
    rows = [(i, kinds[i % 40].tolist(), float(kinds[i % 40].sum() + rng.randn()), 1.0 + i % 3) for i in range(800)]
    seen, blocks = [], it.training_blocks
    monkeypatch.setattr(it, "training_blocks", lambda df, *a: seen.append(df.count()) or blocks(df, *a))
    merged = MLPRegressor(weightCol="w", hidden=3).fit(_rows(spark, rows))
    monkeypatch.setattr(it, "GROUPING", 1e9)
    whole = MLPRegressor(weightCol="w", hidden=3).fit(_rows(spark, rows))
    assert seen == [40, 800]
    a, b = ([r["prediction"] for r in m.transform(_rows(spark, rows)).orderBy("k").collect()] for m in (merged, whole))
    assert np.allclose(a, b, atol=0.02)


def test_rows_are_passed_over_in_slices():
    x = np.arange(9000.0).reshape(4500, 2)
    parts = list(Rows(2, None, None, x).slices())
    assert max(p.n for _, p in parts) <= 2048 and np.array_equal(np.concatenate([x[at] for at, _ in parts]), x)
    assert np.array_equal(np.concatenate([p.val for _, p in parts]), x)


def test_svm_is_calibrated_on_margins_of_rows_it_never_saw(spark):
    # labels are noise and features outnumber what 60 rows can pin down: fitted margins look sure, unseen ones don't
    rng = np.random.RandomState(8)
    rows = [(i, rng.randn(40).tolist(), float(rng.rand() < 0.5), 1.0) for i in range(60)]
    out = ProbabilisticLinearSVC().fit(_rows(spark, rows)).transform(_rows(spark, rows)).collect()
    p = np.array([r["probability"].toArray() for r in out])
    assert np.allclose(p.sum(1), 1) and np.abs(p[:, 1] - 0.5).mean() < 0.25


def test_svm_with_a_class_of_one_row(spark):
    rows = [(i, [float(i), 1.0], float(i == 0), 1.0) for i in range(12)]
    out = ProbabilisticLinearSVC(regParam=0.1).fit(_rows(spark, rows)).transform(_rows(spark, rows)).collect()
    assert all(0 <= r["probability"][1] <= 1 for r in out)


def test_svm_machines_are_optimal_and_fold_free(spark):
    rows = _classes(150)
    fitted = ProbabilisticLinearSVC(weightCol="w", numClasses=3, regParam=0.01).fit(_rows(spark, rows).repartition(5))
    X, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.array([r[3] for r in rows])

    def value(v, k):
        z = 1 - np.where(y == k, 1.0, -1.0) * (X @ v[:3] + v[3])
        return (w * np.maximum(z, 0)).sum() / w.sum() + 0.005 * v[:3] @ v[:3]

    rng = np.random.RandomState(4)
    for k, (coef, b, slope, _) in enumerate(fitted.getModelData()[1]):
        v = np.array([*coef, b])
        assert slope > 0
        # the rounded hinge lies within half the rounding below the hinge: no neighbour is better by more
        assert all(value(v + s * rng.randn(4), k) > value(v, k) - 0.05 for s in (0.01, 0.1, 1.0) for _ in range(20))
    out = fitted.transform(_rows(spark, rows)).select("label", "prediction").collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.8


def test_svm_without_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        ProbabilisticLinearSVC().fit(_rows(spark, []))


def test_quadratic_discriminant_leaves_out_directions_without_variance(spark):
    from quarry.operators.models.closed_form import QuadraticDiscriminant
    rng = np.random.RandomState(0)
    kind, label = rng.randint(0, 3, 400), (rng.rand(400) < 0.5).astype(float)
    rows = [(i, float(x), *[float(k == j) for j in range(3)], float(y), 0.1)
            for i, (x, k, y) in enumerate(zip(rng.randn(400) + label, kind, label))]
    d = spark.createDataFrame(rows, "id int, x double, a double, b double, c double, label double, w double")

    def shares(*columns):
        v = VectorAssembler(inputCols=list(columns), outputCol="features").transform(d)
        model = QuadraticDiscriminant(weightCol="w").fit(v)
        return np.array([r["probability"].toArray() for r in model.transform(v).orderBy("id").collect()])

    # the third of the one-hot columns is one less the others: it says nothing new
    assert np.allclose(shares("x", "a", "b", "c"), shares("x", "a", "b"), atol=1e-6)


def test_models_of_a_zoo_are_fitted_side_by_side(spark):
    import threading
    from quarry.plans.experiment import Experiment
    from quarry.plans.q_models import _zoo
    d = spark.createDataFrame([(i, float(i % 7), float(i % 7) * 2 + 1) for i in range(400)], "id int, x double, y double")
    exp = Experiment(d, "y", False, key="id", nums=["x"], validation_method="test")
    exp.models = {m: exp.models[m] for m in ("Linear Regression", "Ridge Regression", "Linear SVM", "Dummy Benchmark")}
    want = {}
    for m in exp.models:
        exp.fit_fixed(m, {"mod__alpha": 1.0, "mod__C": 1.0})
        want[m] = exp.score(exp.fitted[m], exp.split(False))
    met, one_by_one = threading.Barrier(4), exp.fit_fixed
    exp.fit_fixed = lambda model, params: met.wait(60) and False or one_by_one(model, {"mod__alpha": 1.0, "mod__C": 1.0})
    got = {r["model"]: r["holdout_score"] for r in _zoo(exp).collect()}
    assert list(got) == list(want) and np.allclose(list(got.values()), list(want.values()), atol=1e-9)


def test_short_sums_meet_on_the_driver_with_the_same_bits(spark, monkeypatch):
    from quarry.operators.models import blocks as B
    d = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(
        spark.range(5000, numPartitions=7).select(F.sin("id").alias("x"), F.cos("id").alias("z"), F.tan("id").alias("label")))
    packed = B.training_blocks(d, "features", "label", F.lit(1.0)).persist()
    fn = lambda theta, x, y, w: (float((w * y).sum()), x.back((w * y)[:, None]).ravel())
    stages = spark.sparkContext.statusTracker()

    def run(tag):
        spark.sparkContext.setJobGroup(tag, tag)
        f, g, n = B.sum_over(packed, np.zeros(2), fn)
        spark.sparkContext._jsc.clearJobGroup()
        jobs = stages.getJobIdsForGroup(tag)
        return (f, g.tolist(), n), sum(len(stages.getJobInfo(j).stageIds) for j in jobs)

    packed.count()
    few, short = run("few")
    monkeypatch.setattr(B, "DRIVER_VALUES", 0)
    many, long = run("many")
    packed.unpersist()
    assert few == many and few[2] == 5000.0 and short < long
