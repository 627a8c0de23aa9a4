"""Nearest neighbours (R14, K12): the pivot index against all distances."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quarry.operators.models.neighbours import KNeighborsClassifier, KNeighborsRegressor
from quarry.operators.pivot_index import PivotIndex, point_key


def brute(rows, query, k):
    """(d, tie, y) of the k nearest of rows (x, tie, y)."""
    out = []
    for x, tie, y in rows:
        s = 0.0
        for a, b in zip(x, query):
            s += (a - b) * (a - b)
        out.append((math.sqrt(s), tie, y))
    return sorted(out)[:k]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    clusters = rng.standard_normal((12, 4)) * 10
    x = np.concatenate([clusters[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 4)),
                        rng.integers(0, 3, (300, 4)).astype(float), np.tile([1.0, 2.0, 0.0, 1.0], (600, 1)),
                        [[0.0] * 4, [-0.0] * 4, [1e9] * 4]])
    ties = rng.permutation(len(x))
    return [(v.tolist(), int(t), float(t % 5)) for v, t in zip(x, ties)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "x array<double>, tie bigint, y double")


@pytest.mark.parametrize("k", [1, 5, 20])
@pytest.mark.parametrize("cell_rows,pivots,parts", [(4096, 2048, 3), (17, 40, 8)])
def test_equal_to_all_distances(spark, points, k, cell_rows, pivots, parts):
    index = PivotIndex.build(frame(spark, points).repartition(parts), 20, pivots, cell_rows)
    rng = np.random.default_rng(4)
    asked = [p[0] for p in points[::40]] + (rng.standard_normal((40, 4)) * 12).tolist() + [[0.5] * 4, [1e9, 0.0, 0.0, 0.0]]
    queries = spark.createDataFrame([(q,) for q in asked * 2], "x array<double>")
    names = {r.q: r.x for r in queries.select(point_key("x").alias("q"), "x").collect()}
    found = index.nearest(queries, k).collect()
    assert len(found) == len({tuple(q) for q in asked})
    for r in found:
        assert [(p.d, p.tie, p.y) for p in r.near] == brute(points, names[r.q], k)


def test_far_parts_are_not_visited(spark, points):
    cells = PivotIndex.build(frame(spark, points), 5).cells
    visited = 0
    for (home, d, s), (x, _, _) in zip(cells.routes(np.array([p[0] for p in points]), 5), points):
        limit = brute(points, x, 5)[-1][0]
        visited += len(np.union1d(home, cells.within(d, float(s), limit)))
    assert visited < 0.25 * len(cells.parts) * len(points)


def test_few_rows_empty_and_odd_points(spark):
    rows = [([1.0, 1.0], 1, 7.0), (None, 2, 1.0), ([float("nan"), 0.0], 3, 1.0), ([2.0, 1.0], 4, 9.0)]
    index = PivotIndex.build(frame(spark, rows), 20)
    queries = spark.createDataFrame([([1.0, 1.0],), (None,), ([float("inf"), 1.0],)], "x array<double>")
    found = index.nearest(queries, 20).collect()
    assert [[(p.d, p.y) for p in r.near] for r in found] == [[(0.0, 7.0), (1.0, 9.0)]]
    assert PivotIndex.build(frame(spark, rows).limit(0), 3).nearest(queries, 3).count() == 0


def _data(spark, rows):
    return spark.createDataFrame(rows, "key bigint, x array<double>, label double, q string").withColumn(
        "features", array_to_vector("x"))


def test_votes_by_weighting_and_saving(spark, tmp_path):
    train = [(1, [0.0], 1.0, "a"), (2, [1.0], 0.0, "b"), (3, [3.0], 0.0, "c"), (9, [-1.0], 2.0, "d")]
    asked = _data(spark, [(0, [0.0], 0.0, "q"), (1, [0.5], 0.0, "q"), (2, [2.0], 0.0, "q"), (3, [0.5], 0.0, "r")])
    reg = Pipeline(stages=[KNeighborsRegressor(nNeighbors=3, weighting="distance", keyCols=["key"])]).fit(_data(spark, train))
    reg.write().save(str(tmp_path / "m"))
    for model in (reg, PipelineModel.load(str(tmp_path / "m"))):
        got = {r["key"]: r.prediction for r in model.transform(asked).collect()}
        assert got[0] == 1.0                                            # the one at distance 0 decides
        assert got[1] == got[3] == pytest.approx((1 / 0.5 + 0 + 2 / 1.5) / (2 + 2 + 1 / 1.5))
        assert got[2] == pytest.approx((1 / 2) / (1 + 1 + 1 / 2))
    clf = KNeighborsClassifier(nNeighbors=3, numClasses=3, keyCols=["key"]).fit(_data(spark, train))
    rows = {r["key"]: (r.prediction, r.p) for r in clf.transform(asked).withColumn("p", vector_to_array("probability")).collect()}
    # at 0 the second and third places are 1.0 and -1.0 at one distance; equal shares go to the first class
    assert rows[0] == (0.0, pytest.approx([1 / 3] * 3))
    assert rows[2] == (0.0, pytest.approx([2 / 3, 1 / 3, 0]))
    one = clf.voting(1).transform(asked).select("key", "prediction").collect()
    assert {r["key"]: r.prediction for r in one} == {0: 1.0, 1: 1.0, 2: 0.0, 3: 1.0}
    with pytest.raises(ValueError):
        clf.voting(4)
    assert clf.transform(asked).columns[:5] == asked.columns


def test_one_search_answers_every_vote(spark, sf_small, monkeypatch):
    import __spark_entry__ as entry
    asked, nearest = [], PivotIndex.nearest
    monkeypatch.setattr(PivotIndex, "nearest", lambda self, df, k: asked.append(k) or nearest(self, df, k))
    out = entry.queries()["knn_classification"](spark, sf_small)
    assert asked == [20]
    assert out.groupBy("k", "weights").count().count() == 6


@pytest.mark.parametrize("floats", [64, 1 << 22])
def test_vectors_that_no_bound_tells_apart(spark, monkeypatch, floats):
    # bounds leave out little: a query is a row for each stripe, not for each of its parts
    from quarry.operators import pivot_index as P
    monkeypatch.setattr(P, "STRIPE_FLOATS", floats)
    monkeypatch.setattr(P, "CORE_STRIPES", 1)
    rng = np.random.default_rng(5)
    points = [(v.tolist(), i, float(i % 3)) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    index = PivotIndex.build(frame(spark, points).repartition(4), 9, 30, 20)
    asked = rng.standard_normal((60, 16))
    queries = spark.createDataFrame([(q.tolist(),) for q in asked], "x array<double>")
    names = {r.q: r.x for r in queries.select(point_key("x").alias("q"), "x").collect()}
    found = index.nearest(queries, 9).collect()
    assert len(found) == 60
    for r in found:
        assert [(p.d, p.tie, p.y) for p in r.near] == brute(points, names[r.q], 9)
    stripes = index._stripes(4)
    assert len(stripes) == len(index.cells.parts) and (np.diff(stripes) >= 0).all()
    if floats > 64:
        rows = queries.select(point_key("x").alias("q"), "x", F.lit(1e3).alias("limit")).toArrow().to_batches()
        visits = sum(b.num_rows for b in P._route(index.cells, 9, stripes)(iter(rows)))
        assert visits == 60 * len(set(stripes.tolist())) < 60 * len(index.cells.parts) / 4
