"""Invariants for the operators whose results are not SQL-expressible."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import validation as V
from quarry.operators.models.catalogue import Dim
from quarry.operators.models.closed_form import (DummyClassifier, GaussianNB, LinearDiscriminant,
                                                 QuadraticDiscriminant)
from quarry.operators.models.linear import PenalisedLinearRegression, ridge_line
from quarry.operators.search import decoded, plan_trials, space_size
from quarry.sources.paging import numbered

SF = "/root/testdata/sf0.01"


def test_kfold_partitions_rows(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    f = V.kfold(o, "o_orderkey", 5)
    assert f.count() == o.count()
    assert {r[0] for r in f.select("fold").distinct().collect()} == set(range(5))


def test_stratified_folds_balanced(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    f = V.stratified_kfold(o, "o_orderkey", "o_orderstatus", 5)
    counts = f.groupBy("o_orderstatus", "fold").count().collect()
    by_class = {}
    for r in counts:
        by_class.setdefault(r["o_orderstatus"], []).append(r["count"])
    for sizes in by_class.values():
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_holdout_stable_under_repartition(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    a = {r[0] for r in o.where(V.holdout_flag("o_orderkey", 0.1)).collect()}
    b = {r[0] for r in o.repartition(7).where(V.holdout_flag("o_orderkey", 0.1)).collect()}
    assert a == b
    assert 0.07 < len(a) / o.count() < 0.13


def test_numbering_is_contiguous(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey")
    rows = numbered(c, "c_custkey").orderBy("c_custkey").collect()
    assert [r["#"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["page"] for r in rows] == [(i - 1) // 100 for i in range(1, len(rows) + 1)]


def _emb(spark, k=3):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e = e.select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(k)])
    return VectorAssembler(inputCols=[f"e{i}" for i in range(k)], outputCol="features").transform(e)


@pytest.mark.parametrize("est", [GaussianNB, LinearDiscriminant, QuadraticDiscriminant, DummyClassifier])
def test_probabilities_sum_to_one(spark, est):
    d = _emb(spark)
    out = est().fit(d).transform(d).select(vector_to_array("probability").alias("p"), "prediction")
    for r in out.collect():
        assert abs(sum(r["p"]) - 1.0) < 1e-9
        assert r["p"][int(r["prediction"])] == max(r["p"])


def test_roc_monotone_and_auc_matches_pairs(spark):
    rng = np.random.RandomState(0)
    s = np.round(rng.rand(400), 2)
    y = (rng.rand(400) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    curve = M.roc_curve(df, F.col("y") == 1, "s").orderBy(F.desc("threshold")).collect()
    tpr = [r["tpr"] for r in curve]
    fpr = [r["fpr"] for r in curve]
    assert tpr == sorted(tpr) and fpr == sorted(fpr)
    assert abs(tpr[-1] - 1) < 1e-12 and abs(fpr[-1] - 1) < 1e-12
    auc = M.roc_auc(df, F.col("y") == 1, "s").first()[0]
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])
    assert abs(auc - brute) < 1e-9


def test_ridge_matches_closed_form(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x"),
                                                             "l_extendedprice")
    n = li.count()
    want = ridge_line(li, "x", "l_extendedprice", 5000.0).first()
    v = VectorAssembler(inputCols=["x"], outputCol="features").transform(li)
    m = PenalisedLinearRegression(labelCol="l_extendedprice", l2=5000.0 / n).fit(v)
    assert math.isclose(m.coefficients[0], want["slope"], rel_tol=1e-6)
    assert math.isclose(m.intercept, want["intercept"], rel_tol=1e-6)


def test_planned_trials_lie_in_the_domain(spark):
    dom = [Dim("mod__alpha", "exponential", (-5, 5)), Dim("mod__max_depth", "integer", (1, 15)),
           Dim("pre__nums__scaler", "categoric", ("MinMax", "MaxAbs")),
           Dim("mod__class_weight", "categoric", (None, "balanced")),
           Dim("mod__hidden_layer_sizes", "integer", (5, 50)), Dim("mod__l1_ratio", "float", (0.25, 0.5))]
    rows = plan_trials(spark, dom, 0, 200, seed=3).orderBy("trial").collect()
    assert [r["trial"] for r in rows] == list(range(200))
    params = [decoded(r["params"]) for r in rows]
    for p in params:
        assert math.exp(-5) <= p["mod__alpha"] <= math.exp(5)
        assert 1 <= p["mod__max_depth"] <= 15 and 0.25 <= p["mod__l1_ratio"] <= 0.5
        assert p["pre__nums__scaler"] in ("MinMax", "MaxAbs") and p.get("mod__class_weight") in (None, "balanced")
        assert len(p["mod__hidden_layer_sizes"]) == 1 and 5 <= p["mod__hidden_layer_sizes"][0] <= 50
    assert {p["mod__max_depth"] for p in params} == set(range(1, 16))
    assert [r["params"] for r in plan_trials(spark, dom, 150, 50, seed=3).orderBy("trial").collect()] == [
        r["params"] for r in rows[150:]]
    assert space_size(dom) is None and space_size(dom[1:4]) == 60


def test_feature_importance_scaled(spark):
    from quarry.plans.experiment import Experiment
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    exp = Experiment(li, "l_extendedprice", False, key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
                     nums=["l_quantity", "l_discount"], cats=["l_returnflag"], validation_method="test")
    exp.fit_fixed("Decision Tree", {"mod__max_depth": 3, "mod__min_samples_leaf": 1})
    imp = [r["Importance"] for r in exp.feature_importance("Decision Tree").collect()]
    assert all(0 <= v <= 1 for v in imp) and max(imp) == pytest.approx(1.0)


def _prices(spark, **options):
    from quarry.plans.experiment import Experiment
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    return Experiment(li, "l_extendedprice", False, key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
                      nums=["l_quantity"], **options)


def test_search_walks_a_finite_space_once(spark):
    exp = _prices(spark, validation_method="test")
    exp.fit_model("Linear Regression", max_trials=50)       # two imputers
    assert len(exp.trials["Linear Regression"]) == 2
    exp.fit_model("Linear Regression", max_trials=50)
    points = [t["point"] for t in exp.trials["Linear Regression"]]
    assert len(points) == len(set(points)) == 2
    assert exp.holdout_scores["Linear Regression"] is not None


@pytest.mark.parametrize("method,groups", [("cv", None), ("group", "l_returnflag")])
def test_fold_loop(spark, method, groups):
    exp = _prices(spark, validation_method=method, validation_size=3, groups=groups)
    exp.fit_model("Linear Regression", max_trials=1)
    t = exp.trials["Linear Regression"][0]
    d = exp.split(True).select("__fold", F.col("l_quantity").cast("double").alias("x"), F.col("label").alias("y")).toPandas()
    want = []
    for f in sorted(d["__fold"].unique()):
        tr, te = d[d["__fold"] != f], d[d["__fold"] == f]
        b, a = np.polyfit(tr.x, tr.y, 1)
        want.append(1 - ((te.y - a - b * te.x) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum())
    assert t["score"] == pytest.approx(np.mean(want)) and t["score_std"] == pytest.approx(np.std(want))
    exp.release()


def test_r2_of_a_large_mean(spark):
    rng = np.random.RandomState(0)
    y = 1.7e9 + 0.3 * rng.randn(500)
    p, w = y + 0.1 * rng.randn(500), rng.rand(500) + 0.5
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, p, w)], "y double, p double, w double")
    got = df.agg(M.r2("y", "p").alias("a"), M.r2("y", "p", "w").alias("b")).first()
    assert got["a"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)
    m = (w * y).sum() / w.sum()
    assert got["b"] == pytest.approx(1 - (w * (y - p) ** 2).sum() / (w * (y - m) ** 2).sum(), abs=1e-4)


def test_msle_is_null_below_minus_one(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, -3.0)], "y double, p double")
    assert df.agg(M.msle("y", "p").alias("m")).first()["m"] is None
    assert df.where("p > 0").agg(M.msle("y", "p").alias("m")).first()["m"] == 0


def test_median_error_and_quantiles(spark):
    from quarry.operators.quantiles import exact_quantiles
    rng = np.random.RandomState(1)
    g, v, w = rng.randint(0, 3, 900), np.round(rng.randn(900), 1), rng.randint(1, 5, 900)
    df = spark.createDataFrame([(None if a == 2 else int(a), float(b), float(c)) for a, b, c in zip(g, v, w)],
                               "g int, v double, w double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in exact_quantiles(df, ["g"], "v", probs).collect():
        assert r["q"] == pytest.approx(np.quantile(v[g == (2 if r["g"] is None else r["g"])], probs))
    for r in exact_quantiles(df, ["g"], "v", [0.5], F.col("w")).collect():
        m = g == (2 if r["g"] is None else r["g"])
        o = np.argsort(v[m], kind="stable")
        want = v[m][o][np.searchsorted(np.cumsum(w[m][o]), 0.5 * w[m].sum())]
        assert r["q"][0] == want
    rows = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 5.0, 9.0), (0.0, 2.0, 1.0)], "y double, p double, w double")
    assert M.median_absolute_error(rows, "y", "p").first()["medae"] == 2.0
    assert M.median_absolute_error(rows, "y", "p", "w").first()["medae"] == 5.0


def test_small_holdout_share(spark):
    o = spark.range(200000).withColumnRenamed("id", "k")
    assert 30 < o.where(V.holdout_flag("k", 0.0004)).count() < 140


def test_stratified_folds_do_not_depend_on_ranges(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    a, b = (sorted(map(tuple, V.stratified_kfold(o, "o_orderkey", "o_orderstatus", 4, sub_buckets=n).collect()))
            for n in (1, 37))
    assert a == b


def test_svr_is_ridge_and_weights_count(spark):
    from quarry.operators.models.catalogue import Context, regression_models
    from quarry.operators.models.online import PassiveAggressiveRegressor
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("y"), F.lit(1.0).alias("w"))
    n = li.count()
    v = VectorAssembler(inputCols=["x"], outputCol="features").transform(li)
    svr = regression_models(["x"])["Linear SVM"].build({"mod__C": 0.01}, Context(n=n, label="y", weight="w"))[0].fit(v)
    want = ridge_line(li, "x", "y", 1.0 / (2.0 * 0.01)).first()
    assert math.isclose(svr.coefficients[0], want["slope"], rel_tol=1e-5)
    pa = PassiveAggressiveRegressor(labelCol="y", weightCol="w", C=1.0, epochs=2).fit(v)
    assert len(pa.getModelData()[0]) == 1


def _kinds(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        "vec_id", (F.col("label") % 3).cast("double").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)])
    return VectorAssembler(inputCols=[f"e{i}" for i in range(4)], outputCol="features").transform(e)


def test_extra_trees_differ(spark):
    from quarry.operators.models.catalogue import Context, regression_models
    d = _kinds(spark).withColumn("__w", F.lit(1.0))
    params = {"mod__max_depth": 4, "mod__min_samples_leaf": 1}
    forest = regression_models(["e0"])["Extra Trees"].build(params, Context(n=500.0))[0].fit(d)
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) > 1


@pytest.mark.parametrize("name", ["ada_reg", "ada_cls", "ovr"])
def test_ensembles_are_saved_whole(spark, tmp_path, name):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from quarry.operators.models import iterative as it
    d = _kinds(spark)
    est = {"ada_reg": it.AdaBoostRegressor(nEstimators=3), "ada_cls": it.AdaBoostClassifier(nEstimators=3, numClasses=3),
           "ovr": it.OneVsRestProbabilistic(classifier=GBTClassifier(maxIter=2, maxDepth=2), numClasses=3)}[name]
    model = Pipeline(stages=[est]).fit(d)
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    a, b = (sorted(map(tuple, m.transform(d).select("vec_id", "prediction").collect())) for m in (model, back))
    assert a == b
    imp = back.stages[0].featureImportances.toArray()
    assert len(imp) == 4 and abs(imp.sum() - 1) < 1e-6


def test_project_is_loaded_with_its_search(spark, tmp_path):
    from quarry.plans.experiment import Project
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    project = Project(li, "p")
    exp = project.new_experiment(target="l_extendedprice", classification=False, nums=["l_quantity"], cats=["l_returnflag"],
                                 key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], validation_method="test", seed=7)
    exp.fit_model("Decision Tree", max_trials=1)
    project.save(str(tmp_path / "p"))
    back = Project.load(li, str(tmp_path / "p"))
    again = back.experiments[0]
    assert (back.name, again.seed) == ("p", 7)
    assert again.trials["Decision Tree"] == exp.trials["Decision Tree"]
    again.fit_model("Decision Tree", max_trials=2)
    assert len({t["point"] for t in again.trials["Decision Tree"]}) == 2
    assert again.importance_by_variable("Decision Tree").count() <= 2


def test_absent_numeric_column_is_imputed(spark):
    from quarry.operators.features import NumericBlock
    d = spark.createDataFrame([(1.0, 4.0), (3.0, 8.0)], "a double, b double")
    model = NumericBlock(inputCols=["a", "b"], outputCol="v").fit(d)
    out = model.transform(d.drop("b"))
    assert out.columns == ["a", "v"]
    assert [list(r["v"].toArray()) for r in out.orderBy("a").collect()] == [[1.0, 6.0], [3.0, 6.0]]


def test_csv_preview_and_missing_file(spark, tmp_path):
    from quarry.sources.files import open_table
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "\n".join(f"{i},x{i}" for i in range(100)) + "\nlast,y\n")
    assert [tuple(r) for r in open_table(spark, str(path), nrows=2).collect()] == [(0, "x0"), (1, "x1")]
    assert open_table(spark, str(path)).count() == 101
    with pytest.raises(FileNotFoundError):
        open_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        open_table(spark, str(tmp_path / "t.txt"))


def test_text_query_takes_every_text_classifier(spark, sf_small, monkeypatch):
    import __spark_entry__ as entry
    from quarry.operators.models import catalogue
    from quarry.plans import q_models
    taken = []
    monkeypatch.setattr(q_models, "_zoo", lambda exp: taken.extend(exp.models) or exp.data)
    entry.queries()["text_classification_models"](spark, sf_small)
    assert set(catalogue.classification_models(cats=["lang"], text=["text"])) <= set(taken)
    assert {"Linear SVM", "Kernel SVM", "Gradient Boosted Trees", "Neural Network"} <= set(taken)
