import math

import numpy as np
import pytest

from quarry.llm import ann_forest, exact_topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, block string"


def table(spark, vectors):
    rows = [(int(i), None if v is None else [None if x is None else float(x) for x in v], 0, "k", "b")
            for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((8, 24))
    x = np.concatenate([rng.standard_normal((500, 24)), centre[rng.integers(0, 8, 500)] + 0.05 * rng.standard_normal((500, 24))])
    return x.astype(np.float32).astype(np.float64)


def exact_cosine(x, i, k):
    n = np.linalg.norm(x, axis=1)
    c = x @ x[i] / (n * n[i])
    return [j for j in np.lexsort((np.arange(len(x)), -c)).tolist() if j != i][:k], c


@pytest.mark.parametrize("block_rows", [8192, 300])
def test_forest_recall_and_scores(spark, vectors, block_rows):
    found = ann_forest.nearest(table(spark, enumerate(vectors)), query_step=10, block_rows=block_rows).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q, answers in by.items():
        want, c = exact_cosine(vectors, q, 5)
        assert sorted(answers) == [1, 2, 3, 4, 5]
        assert all(abs(c[v] - s) < 1e-12 for v, s in answers.values())
        assert [s for _, (_, s) in sorted(answers.items())] == sorted((s for _, s in answers.values()), reverse=True)
        hits += len(set(want) & {v for v, _ in answers.values()})
    assert len(by) == 100 and hits >= 0.9 * 500


@pytest.mark.parametrize("block_rows", [8192, 300])
def test_top_k_is_exact(spark, vectors, block_rows):
    found = exact_topk.top_k(table(spark, enumerate(vectors)), query_step=20, block_rows=block_rows).collect()
    z = np.floor(1024 * vectors).astype(np.int64)
    want = []
    for q in range(0, 1000, 20):
        s = z @ z[q]
        order = [j for j in np.lexsort((np.arange(1000), -s)).tolist() if j != q][:10]
        want += [(q, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_large_components_keep_their_scores(spark):
    rows = [(0, [1e6, 0.5]), (1, [2e6, 0.25]), (2, [3e6, 0.0]), (3, [-4e6, 1.0]), (4, [1e300, 0.0]), (5, [1e307, -1e307])]
    z = {i: [math.floor(1024 * x) if abs(x) < 1e305 else None for x in map(float, v)] for i, v in rows}
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in exact_topk.top_k(docs, query_step=1).collect()}
    top = (1 << 63) - 1
    for i, j in ((0, 1), (0, 2), (1, 2), (2, 3), (0, 3)):
        want = sum(a * b for a, b in zip(z[i], z[j]))
        assert got[i, j] == got[j, i] == max(-top - 1, min(top, want))
    assert got[0, 4] == top and got[3, 4] == -top - 1 and got[4, 5] == top
    assert [r.vec_id for r in exact_topk.top_k(docs, query_step=7).where("rank <= 4").orderBy("rank").collect()] == [4, 5, 2, 1]


def test_bounds_hold(vectors):
    z = np.floor(1024 * vectors)
    for segments in (1, 4, 16):
        width, mean, dev = exact_topk.segment_statistics(z, segments)
        bound = mean @ (width * mean[0]) + dev @ (width * dev[0])
        assert (bound >= z @ z[0] - 1e-3).all()


@pytest.mark.parametrize("search,k", [(ann_forest.nearest, 5), (exact_topk.top_k, 10)])
def test_ties_copies_and_invalid_vectors(spark, search, k):
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(30)] + [(0, same)]
    rows += [(100, None), (200, [0, 0, 0]), (300, [1, None, 2]), (400, [float("nan"), 1, 1]), (500, [float("inf"), 1, 1]),
             (600, []), (700, [1.0, 1.0])]
    found = search(table(spark, rows), query_step=100).collect()
    own = sorted((r["rank"], r.vec_id) for r in found if r.query_id == 0)
    assert own == [(i, i) for i in range(1, k + 1)]
    asked = {r.query_id for r in found}
    assert asked <= {0, 200}        # a zero vector has inner products but no cosine; two components meet no three


@pytest.mark.parametrize("search", [ann_forest.nearest, exact_topk.top_k])
def test_few_rows_and_empty_table(spark, search):
    assert search(table(spark, [(0, [1, 0]), (3, [1, 1])])).count() == 1
    assert search(table(spark, [(0, [1, 0])])).count() == 0
    assert search(table(spark, [(1, [1, 0])]).limit(0)).count() == 0
