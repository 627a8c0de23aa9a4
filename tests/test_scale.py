"""Steps whose cost must not grow with a group's or the table's rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarry.operators import validation as V
from quarry.operators.models import trees
from quarry.plans.experiment import Experiment


def _frame(spark, n=800):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b)], float(y), float(w)) for i, (a, b, y, w) in enumerate(zip(
        rng.integers(0, 4, n), rng.integers(0, 3, n), rng.integers(0, 3, n), rng.integers(0, 3, n)))]
    df = spark.createDataFrame(rows, "key bigint, x array<double>, label double, weight double")
    return df.withColumn("features", array_to_vector("x")).repartition(4)


@pytest.mark.parametrize("criterion, classes", [("mse", 0), ("friedman_mse", 0), ("mae", 0), ("gini", 3), ("entropy", 3)])
def test_levels_pass_over_groups_of_rows(spark, monkeypatch, criterion, classes):
    df, passed, grow = _frame(spark), [], trees.grow

    def watched(data, *args):
        passed.append(data.count())
        return grow(data, *args)

    monkeypatch.setattr(trees, "grow", watched)
    est = trees.TreeEnsemble(weightCol="weight", criterion=criterion, maxDepth=3, minLeaf=5, numClasses=classes)
    few = est.fit(df)
    assert passed.pop() <= 12 * (1 if "mse" in criterion else 3)
    monkeypatch.setattr(trees, "GROUPING", 10 ** 9)
    whole = est.fit(df)
    assert passed.pop() == 800
    a, b = few.getModelData(), whole.getModelData()
    for t, u in zip(a[0], b[0]):
        assert t[:4] == u[:4] and t[5] == u[5]
        assert np.allclose(t[4], u[4])
    assert np.allclose(a[1], b[1])


@pytest.fixture
def large(spark):
    """As over tables too large for Spark to broadcast by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    yield
    spark.conf.set(name, before)


def _moved(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_class_weights_do_not_move_the_rows(spark, large):
    df = _frame(spark).withColumn("c", F.col("label").cast("int"))
    exp = Experiment(df, "c", True, key="key", nums=["weight"], validation_method="test")
    assert not _moved(exp.prepared())
    got = {r["label"]: r["w"] for r in exp.prepared().groupBy("label").agg(F.max("__cw").alias("w")).collect()}
    n = {r["label"]: r["count"] for r in exp.split(True).groupBy("label").count().collect()}
    exp.release()
    assert got == pytest.approx({k: sum(n.values()) / (len(n) * v) for k, v in n.items()})


def test_few_groups_do_not_move_the_rows(spark, large):
    rows = [(i, None if i % 10 == 0 else "ab"[i % 2]) for i in range(50)]
    df = V.group_folds(spark.createDataFrame(rows, "id int, g string"), "g")
    assert not _moved(df)
    assert {(r["g"], r["fold"]) for r in df.collect()} == {(None, None), ("a", 0), ("b", 1)}


def test_words_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    from quarry.operators import text
    made, cut = [], text.cut_lineage

    def watched(df):
        made.append(df.rdd.getNumPartitions())
        return cut(df)

    monkeypatch.setattr(text, "cut_lineage", watched)
    monkeypatch.setattr(text, "TASK_TEXT", 64, raising=False)
    rows = [(i, f"alpha beta beta word{i % 3}" + " gamma" * (i % 2)) for i in range(200)] + [(0, "beta delta"), (None, "alpha"), (7, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    out = text.tfidf(df, "id", "t", min_df=0.0)
    size = sum(len(t or "") for _, t in rows)
    assert made == [-(-size // 64)]
    norms = out.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert len(norms) == 201 and all(abs(r["s"] - 1) < 1e-9 for r in norms)


def test_vocabulary_is_one_aggregate(spark):
    from pyspark.ml.feature import CountVectorizer
    from quarry.operators.features import text_stages
    assert not any(isinstance(s, CountVectorizer) for s in text_stages(["t"]))
    from quarry.operators.features import WordCounts
    rows = [(["b", "a", "b"],), (["a", "c"],), (["b", "d", "a"],), ([],), (["e", "e", "e", "e"],)]
    df = spark.createDataFrame(rows, "w array<string>")
    model = WordCounts(inputCol="w", outputCol="v", minDF=0.4).fit(df)
    assert model.vocabulary == ["a", "b"]
    theirs = CountVectorizer(inputCol="w", outputCol="v", minDF=0.4).fit(df)
    assert set(theirs.vocabulary) == {"a", "b"}
    assert WordCounts(inputCol="w", outputCol="v", minDF=0.0).fit(df).vocabulary == ["e", "a", "b", "c", "d"]
    assert [r["v"].toArray().tolist() for r in model.transform(df).collect()] == [[1, 2], [1, 0], [1, 1], [0, 0], [0, 0]]
    with pytest.raises(ValueError):
        WordCounts(inputCol="w", outputCol="v", minDF=1.0).fit(df)


def test_passes_over_few_numbers_are_few_tasks(spark):
    from quarry.operators.models import blocks as B
    df = _frame(spark).repartition(16)
    packed = B.training_blocks(df, "features", "label", F.col("weight")).persist()
    d, tasks = B.measured(packed)
    assert (d, tasks) == (2, 1)
    total = lambda theta, x, y, w: (float((w * y).sum()), x.back(w[:, None]).ravel())
    f, g, n = B.sum_over(packed, np.zeros(2), total, tasks)
    again = B.sum_over(packed, np.zeros(2), total)
    rows = df.toPandas()
    assert f == again[0] == (rows.weight * rows.label).sum() and n == again[2] == rows.weight.sum()
    assert g.tolist() == again[1].tolist() == (np.stack(rows.x) * rows.weight.to_numpy()[:, None]).sum(0).tolist()
    assert B.measured(packed.limit(0))[0] is None
    packed.unpersist()
