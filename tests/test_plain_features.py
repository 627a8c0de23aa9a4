"""Features as plain numbers: the same as the assembled vector, and what is computed from them without it."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators.features import preprocessor
from quarry.operators.models import linear, trees
from quarry.operators.models.linear import PenalisedLinearRegression
from quarry.operators.models.trees import TreeEnsemble


def _table(spark, n=400, seed=2):
    rng = np.random.RandomState(seed)
    rows = [(i, None if i % 17 == 0 else float(rng.randint(0, 9)), 1e6 + float(rng.randn()), None if i % 13 == 0 else "abc"[rng.randint(3)],
             float(rng.randn()), float(rng.randint(1, 4))) for i in range(n)]
    d = spark.createDataFrame(rows, "k long, a double, b double, c string, e double, w double")
    return d.withColumn("label", F.coalesce("a", F.lit(0.0)) * 2 + (F.col("b") - 1e6) * 3 + F.col("e") + F.when(F.col("c") == "b", 5.0).otherwise(0.0))


@pytest.mark.parametrize("scaler", [None, "MinMax", "MaxAbs", "Standard", "Robust"])
def test_plain_features_are_those_of_the_vector(spark, tmp_path, scaler):
    d = _table(spark)
    fitted = preprocessor(["a", "b"], ["c"], imputer="median", scaler=scaler).fit(d.where("c IS NULL OR c <> 'b'"))
    fitted.write().overwrite().save(str(tmp_path / "m"))
    for model in (fitted, type(fitted).load(str(tmp_path / "m"))):
        out = model.transform(d)
        assert [c for c in out.columns if c.startswith("__nums__")] == []
        pairs = out.select(vector_to_array("features").alias("v"), "features__x").collect()
        assert len(pairs) == 400 and all(r["v"] == r["features__x"] for r in pairs)


def test_many_categories_have_no_plain_features(spark):
    d = _table(spark).withColumn("c", F.col("k").cast("string"))
    assert "features__x" not in preprocessor(["a"], ["c"]).fit(d).transform(d).columns


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("l1,l2", [(0.0, 0.01), (0.2, 0.0), (0.1, 0.3)])
def test_ridge_and_lasso_of_sums_are_those_of_the_rows(spark, monkeypatch, weighted, l1, l2):
    d = _table(spark).withColumn("same", F.lit(7.0))
    d = preprocessor(["a", "b", "same"], ["c"], scaler="Standard").fit(d).transform(d)
    seen, real = [], linear.LinearRegression

    class Counting(real):
        def fit(self, df, *a):
            seen.append(df.count())
            return real.fit(self, df, *a)

    monkeypatch.setattr(linear, "LinearRegression", Counting)
    est = PenalisedLinearRegression(l1=l1, l2=l2, weightCol="w" if weighted else None)
    sums, rows = est.fit(d), est.fit(d.drop("features__x"))
    assert seen == [2 * (7 + 1), 400]       # 3 numbers, 4 categories; the label
    assert np.allclose(sums.coefficients.toArray(), rows.coefficients.toArray(), rtol=1e-5, atol=1e-6)
    a, b = ([r["prediction"] for r in m.transform(d).orderBy("k").collect()] for m in (sums, rows))
    assert np.allclose(a, b, rtol=1e-6, atol=1e-5)


def test_thresholds_are_compared_without_python(spark, monkeypatch):
    d = _table(spark, 300)
    data = preprocessor(["a", "b"], ["c"]).fit(d).transform(d).select(
        F.col("features__x").alias("x"), F.col("label").alias("y"), "w", F.xxhash64("k").alias("rid")).localCheckpoint()
    odd = spark.createDataFrame([([float("nan"), 1e6, 0.0, 0.0, 1.0, 0.0], -3.0, 2.0, 1)], data.schema)
    cuts = [np.arange(0.5, 8), np.quantile(1e6 + np.linspace(-2, 2, 50), np.arange(1, 20) / 20), *[np.array([0.5])] * 3, np.zeros(0)]
    edges = np.array([0.0, 4.0, 9.0])

    def groups():
        g = trees._groups(data.union(odd), 6, cuts, edges)
        rows = {(tuple(r["x"]), r["kind"]): [r["s0"], r["s1"], r["s2"], r["n"]] for r in g.collect()}
        return rows, g._jdf.queryExecution().toString()

    plain, plan = groups()
    monkeypatch.setattr(trees, "PLAIN_CUTS", 0)
    python, other = groups()
    assert "MapInArrow" in other and "MapInArrow" not in plan
    assert plain.keys() == python.keys() and all(np.allclose(plain[k], python[k]) for k in plain)


def test_tree_of_plain_features_is_that_of_the_vector(spark):
    d = _table(spark, 1500)
    d = preprocessor(["a"], ["c"]).fit(d).transform(d)
    for criterion in ("mse", "mae"):
        est = TreeEnsemble(criterion=criterion, maxDepth=4, keyCols=["k"])
        a, b = (est.fit(f).trees[0].listed() for f in (d, d.drop("features__x")))
        assert a[0] == b[0] and a[1] == b[1]
