"""Jobs side by side, early ends and time limits (H4, H5, V6)."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.jobs import OutOfTime, side_by_side, within
from quarry.operators.models.catalogue import Dim
from quarry.operators.search import run_search


def _slow(spark, seconds=60):
    """A job of about ``seconds`` on one core."""
    def nap(batches):
        for b in batches:
            time.sleep(seconds)
            yield b
    return spark.range(1, numPartitions=1).mapInPandas(nap, "id long").count()


def test_results_keep_their_order(spark):
    tasks = [lambda n=n: spark.range(n).count() for n in (300, 20, 7, 100, 1)]
    assert list(side_by_side(spark, tasks, 3)) == [300, 20, 7, 100, 1]


def test_an_early_end_cancels_the_rest(spark):
    began = time.time()
    results = side_by_side(spark, [lambda: 1, lambda: _slow(spark), lambda: _slow(spark)], 2)
    assert next(results) == 1
    results.close()
    assert time.time() - began < 20
    assert spark.range(5).count() == 5          # later jobs aren't touched


def test_an_error_comes_out(spark):
    def bad():
        raise KeyError("x")
    with pytest.raises(KeyError):
        list(side_by_side(spark, [lambda: 1, bad, lambda: 2], 2))
    with pytest.raises(KeyError):
        within(spark, 20, bad)


def test_the_limit_ends_jobs_of_inner_threads(spark):
    began = time.time()
    with pytest.raises(OutOfTime):
        within(spark, 2, lambda: list(side_by_side(spark, [lambda: _slow(spark)] * 2, 2)))
    assert time.time() - began < 20
    assert within(spark, 30, lambda: spark.range(9).count()) == 9


def test_a_search_ends_within_its_budget_and_keeps_its_log(spark):
    calls = []

    def evaluate(params, best_mean, best_std):
        calls.append(params)
        if len(calls) == 3:
            _slow(spark)
        return float(spark.range(4).agg(F.sum("id")).first()[0]), 0.0, 0.1

    began = time.time()
    log = run_search(spark, "e", "m", [Dim("mod__alpha", "float", (0.0, 1.0))], evaluate, max_train_time=6.0)
    assert time.time() - began < 30 and len(calls) == 3
    assert [t["trial"] for t in log] == [0, 1] and all(t["score"] == 6.0 for t in log)


def test_folds_together_give_the_scores_of_folds_one_by_one(spark):
    from quarry.plans.experiment import Experiment
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    exp = Experiment(li, "l_extendedprice", False, key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
                     nums=["l_quantity"], validation_method="cv", validation_size=3)
    train = exp.split(train=True)
    n = train.agg(F.sum("__w")).first()[0]
    evaluate = exp._evaluator("Linear Regression", train, n)
    mean, std, _ = evaluate({}, None, None)
    one_by_one = [exp.score(exp.pipeline("Linear Regression", {}, n).fit(train.where(F.col("__fold") != f)),
                            train.where(F.col("__fold") == f)) for f in range(3)]
    assert mean == pytest.approx(np.mean(one_by_one)) and std == pytest.approx(np.std(one_by_one))
    # a leader far ahead rejects the trial after two folds
    assert evaluate({}, 99.0, 0.0)[0] == pytest.approx(np.mean(one_by_one[:2]))
