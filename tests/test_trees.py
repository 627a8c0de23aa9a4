"""Trees grown on Spark aggregates (R8-R10, R13, K6-K8, K11) against plain enumeration."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array

from quarry.operators.models.trees import SecondOrderBoosting, TreeEnsemble, bootstrap_counts, uniform


def frame(spark, x, y, w=None, parts=4):
    rows = [(i, v.tolist(), float(t), float(1 if w is None else w[i])) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key bigint, x array<double>, label double, weight double")
    return df.withColumn("features", array_to_vector("x")).repartition(parts)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 9, 400), rng.integers(0, 4, 400), rng.integers(0, 30, 400)], axis=1).astype(float)
    y = np.round(3 * (x[:, 0] > 4) + x[:, 1] * (x[:, 2] > 11) + rng.integers(0, 3, 400))
    return x, y, rng.integers(1, 4, 400).astype(float)


def impurity(name, y, w):
    if not len(y):
        return 0.0
    if name in ("gini", "entropy"):
        p = np.array([w[y == c].sum() for c in np.unique(y)]) / w.sum()
        return w.sum() * (1 - (p * p).sum() if name == "gini" else -(p * np.log2(p)).sum())
    if name == "mae":
        o = np.argsort(y, kind="stable")
        up = np.cumsum(w[o])
        low, high = (y[o][np.argmax(f)] for f in (up >= up[-1] / 2, up > up[-1] / 2))
        return (w * np.abs(y - (low + high) / 2)).sum()
    return (w * (y - np.average(y, weights=w)) ** 2).sum()


def enumerated(name, x, y, w, depth, min_split, min_leaf):
    """The tree as nested (feature, threshold, left, right), or a leaf's rows, by trying every split."""
    best = None
    if depth and len(y) >= min_split and impurity(name, y, w) > 1e-12:
        for j in range(x.shape[1]):
            kinds = np.unique(x[:, j])
            for t in (kinds[:-1] + kinds[1:]) / 2:
                left = x[:, j] <= t
                if min(left.sum(), (~left).sum()) < min_leaf:
                    continue
                if name == "friedman_mse":
                    a, b = w[left].sum(), w[~left].sum()
                    gain = a * b * (np.average(y[left], weights=w[left]) - np.average(y[~left], weights=w[~left])) ** 2
                else:
                    gain = impurity(name, y, w) - impurity(name, y[left], w[left]) - impurity(name, y[~left], w[~left])
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                    best = gain, j, t, left
    if best is None:
        return None
    _, j, t, left = best
    return (j, t, *(enumerated(name, x[s], y[s], w[s], depth - 1, min_split, min_leaf) for s in (left, ~left)))


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return None
    return tree.feature[node], tree.threshold[node], nested(tree, tree.left[node]), nested(tree, tree.right[node])


@pytest.mark.parametrize("name", ["mse", "friedman_mse", "mae", "gini", "entropy"])
@pytest.mark.parametrize("min_split,min_leaf", [(2, 1), (150, 30)])
def test_depth_two_trees_equal_an_enumeration(spark, data, name, min_split, min_leaf):
    x, y, w = data
    classes = int(y.max()) + 1 if name in ("gini", "entropy") else 0
    model = TreeEnsemble(weightCol="weight", criterion=name, maxDepth=2, minSplit=min_split, minLeaf=min_leaf,
                         numClasses=classes, keyCols=["key"]).fit(frame(spark, x, y, w))
    assert nested(model.trees()[0]) == enumerated(name, x, y, w, 2, min_split, min_leaf)


def test_leaf_values_and_saving(spark, data, tmp_path):
    x, y, w = data
    df = frame(spark, x, y, w)
    pipe = Pipeline(stages=[TreeEnsemble(weightCol="weight", criterion="mae", maxDepth=1, keyCols=["key"])]).fit(df)
    pipe.write().save(str(tmp_path / "m"))
    f, t, *_ = nested(pipe.stages[0].trees()[0])
    side = x[:, f] <= t
    for model in (pipe, PipelineModel.load(str(tmp_path / "m"))):
        got = {r["key"]: r.prediction for r in model.transform(df).select("key", "prediction").collect()}
        for s in (side, ~side):
            ys = np.repeat(y[s], w[s].astype(int))
            assert {got[i] for i in np.flatnonzero(s).tolist()} == {float(np.median(ys))}


def test_extra_trees_draw_their_thresholds(spark, data):
    x, y, _ = data

    def fit(parts, seed=1):
        return TreeEnsemble(maxDepth=3, numTrees=4, randomThresholds=True, keyCols=["key"], seed=seed).fit(frame(spark, x, y, parts=parts))

    a, b, c = fit(1), fit(7), fit(7, seed=2)
    shapes = [nested(t) for t in a.trees()]
    assert shapes == [nested(t) for t in b.trees()] and shapes != [nested(t) for t in c.trees()]
    assert len({(s[0], s[1]) for s in shapes}) == 4
    kinds = {float(m) for j in range(3) for v in [np.unique(x[:, j])] for m in (v[:-1] + v[1:]) / 2}
    assert not {s[1] for s in shapes} & kinds
    # of the root's random splits the best was taken
    for i, s in enumerate(shapes):
        def gain(j, t):
            left = x[:, j] <= t
            return impurity("mse", y, np.ones(400)) - sum(impurity("mse", y[k], np.ones(k.sum())) for k in (left, ~left) if k.any())
        lo, hi = x.min(axis=0), x.max(axis=0)
        drawn = lo + uniform(np.int64(1), np.int64(i), np.int64(1), np.arange(3)) * (hi - lo)
        j = max(range(3), key=lambda j: gain(j, drawn[j]))
        assert (s[0], s[1]) == (j, pytest.approx(drawn[j]))


def test_forest_bootstraps_by_row(spark, data):
    x, y, _ = data
    counts = bootstrap_counts(np.arange(20000), 3, 42)
    for k in range(5):
        p = math.exp(-1) / math.factorial(k)
        assert abs((counts == k).mean() - p) < 5 * math.sqrt(p / 20000)
    a, b = (TreeEnsemble(maxDepth=4, numTrees=5, bootstrap=True, featureSubset="sqrt", numClasses=int(y.max()) + 1, criterion="gini",
                         keyCols=["key"]).fit(frame(spark, x, y, parts=p)) for p in (2, 5))
    assert [nested(t) for t in a.trees()] == [nested(t) for t in b.trees()]
    assert len({repr(nested(t)) for t in a.trees()}) == 5
    out = a.transform(frame(spark, x, y)).withColumn("p", vector_to_array("probability")).select("label", "prediction", "p").collect()
    assert all(sum(r.p) == pytest.approx(1) for r in out)
    prior = max((y == c).mean() for c in np.unique(y))
    assert np.mean([r.label == r.prediction for r in out]) > prior + 0.15
    assert a.featureImportances.toArray().sum() == pytest.approx(1)


def test_second_order_round_equals_the_closed_form(spark, data):
    x, y, w = data
    df = frame(spark, x, y, w)
    alpha, lam = 7.0, 3.0
    model = SecondOrderBoosting(weightCol="weight", maxDepth=1, nEstimators=1, learningRate=0.5, regAlpha=alpha, regLambda=lam,
                                keyCols=["key"]).fit(df)
    g = w * (np.average(y, weights=w) - y)
    shrunk = lambda v: np.sign(v) * max(abs(v) - alpha, 0)
    score = lambda s: shrunk(g[s].sum()) ** 2 / (w[s].sum() + lam)
    best = max((score(x[:, j] <= t) + score(x[:, j] > t), -j, -t) for j in range(3)
               for v in [np.unique(x[:, j])] for t in (v[:-1] + v[1:]) / 2)
    f, t, *_ = nested(model.trees()[0])
    assert (f, t) == (-best[1], -best[2])
    got = {r["key"]: r.prediction for r in model.transform(df).select("key", "prediction").collect()}
    for s in (x[:, f] <= t, x[:, f] > t):
        want = np.average(y, weights=w) - 0.5 * shrunk(g[s].sum()) / (w[s].sum() + lam)
        assert all(got[i] == pytest.approx(want) for i in np.flatnonzero(s).tolist())


@pytest.mark.parametrize("classes", [2, 3])
def test_penalties_change_a_classifier_that_learns(spark, data, classes):
    x, y, _ = data
    y = np.minimum(y, classes - 1)
    df = frame(spark, x, y)

    def fit(**options):
        return SecondOrderBoosting(maxDepth=2, nEstimators=8, numClasses=classes, keyCols=["key"], **options).fit(df)

    def loss(model):
        rows = model.transform(df).withColumn("p", vector_to_array("probability")).select("label", "p").collect()
        assert all(sum(r.p) == pytest.approx(1) for r in rows)
        return -np.mean([math.log(r.p[int(r.label)]) for r in rows])

    prior = -sum((y == c).mean() * math.log((y == c).mean()) for c in range(classes))
    free, shrunk, none = fit(), fit(regLambda=100.0), fit(regAlpha=1e6)
    assert loss(free) < loss(shrunk) < math.log(classes) and loss(free) < 0.9 * prior
    assert loss(none) == pytest.approx(math.log(classes))


@pytest.mark.parametrize("kind", ["forest", "forest of classes", "extra", "boosted", "boosted classes"])
def test_forests_and_boosting_over_groups_equal_those_over_rows(spark, monkeypatch, kind):
    from quarry.operators.models import trees as T
    rng = np.random.RandomState(5)
    x = rng.randint(0, 5, (3000, 2)).astype(float)
    classes = 3 if "classes" in kind else 0
    y = ((x.sum(axis=1) + rng.randint(0, 4, 3000)) % (classes or 9)).astype(float)
    df = frame(spark, x, y, rng.randint(0, 3, 3000).astype(float))
    passed, grow = [], T.grow
    monkeypatch.setattr(T, "grow", lambda data, *rest: passed.append(data.count()) or grow(data, *rest))

    def fit():
        common = dict(weightCol="weight", keyCols=["key"], numClasses=classes)
        if "boosted" in kind:
            return SecondOrderBoosting(maxDepth=2, nEstimators=3, **common).fit(df)
        return TreeEnsemble(maxDepth=4, numTrees=4, criterion="gini" if classes else "mse", bootstrap="forest" in kind,
                            randomThresholds=kind == "extra", **common).fit(df)

    few = fit()
    assert max(passed) <= 25 * max(classes, 1) * (4 if "forest" in kind else 1)
    monkeypatch.setattr(T, "GROUPING", 10 ** 9)
    many = fit()
    assert passed[-1] > 1000
    for a, b in zip(few.trees, many.trees, strict=True):
        assert (a.feature, a.threshold, a.left) == (b.feature, b.threshold, b.left)
        assert np.allclose(a.value, b.value)
    assert np.allclose(few.featureImportances.toArray(), many.featureImportances.toArray())
