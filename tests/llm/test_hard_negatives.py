import duckdb
import numpy as np
import pytest

from quarry.llm import hard_negatives as hn
from quarry.llm.blocks import whole_products

SCHEMA = "vec_id bigint, embedding array<double>, label int, key string, first int, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "k", 1, "s")
                                  for i, v, l in rows], SCHEMA)


def brute(rows, step=50):
    """Rows of the contract by sorting all scores; labels as they are."""
    rows = {(i, l, tuple(v)): [int(np.floor(256 * x)) for x in v] for i, v, l in rows
            if i is not None and l is not None and v is not None and len(v)
            and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for (a, label, av), z in rows.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(z, w)), i, l) for (i, l, v), w in rows.items() if i != a and len(v) == len(av))
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            near = [(n, j) for n, j, l in scored if l != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(near)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    centre = rng.standard_normal((20, 24))
    x = np.concatenate([rng.standard_normal((500, 24)), centre[rng.integers(0, 20, 500)] + 0.3 * rng.standard_normal((500, 24)),
                        np.round(rng.standard_normal((200, 24)))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, rng.integers(0, 10, len(x))))]


@pytest.mark.parametrize("block_rows", [8192, 200])
def test_equal_to_brute_force(spark, rows, block_rows):
    got = hn.mine(table(spark, rows), block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert len(got) > 200


def test_sql_with_wrong_labels(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id bigint, embedding double[], label int)")
    some = rows[:600] + [(700, None, 1), (750, [1.0], None), (800, [float("nan")] * 24, 2), (850, [], 3), (900, [None] * 24, 1)]
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", some)
    moved = [(i, v, (l + 1) % 10 if l is not None and i % 7 == 0 else l) for i, v, l in some]
    want = brute(moved)
    assert sorted(con.execute(hn.oracle_sql()).fetchall()) == want
    assert sorted(map(tuple, hn.mine(hn.relabelled(table(spark, some))).collect())) == want


def test_bounds_hold(rows):
    z = np.floor(256 * np.array([v for _, v, _ in rows]))
    for offset in (0.0, 1e9):
        x = z + offset
        index = hn.Summaries(x, np.zeros(len(x), dtype=np.int64), np.arange(len(x)))
        stats = [(w, m[3], s[3]) for w, m, s in (hn.summaries(x, k) for k in hn.RESOLUTIONS)]
        exact = x.astype(object) @ x[3].astype(object)
        for level in range(3):
            low, high = index.score_bounds(level, np.arange(len(x)), stats, float(np.linalg.norm(x[3])))
            assert all(a <= s <= b for a, s, b in zip(low.tolist(), exact.tolist(), high.tolist()))


def test_copies_ties_and_hot_vector(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.8, 0.1, 0.0], [0.7, 0.0, 0.1]
    rows = [(i, a, 1) for i in range(0, 120)] + [(i, b, 2) for i in range(200, 260)] + [(i, c, 3) for i in range(300, 320)]
    rows += [(0, a, 1), (50, a, 1)] + [(400, [0.0, 0.0, 0.0], 4), (450, [0.0, 0.0, 0.0], 4), (500, [-1.0, 0.0, 0.0], 5), (501, [1.0, 0, 0], 5)]
    got = hn.mine(table(spark, rows), block_rows=2).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_null_ids_lengths_and_large_components(spark):
    rows = [(None, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.9, 0.9], 2), (3, [1.0], 2),
            (50, [1e6, 3e6], 1), (51, [2e6, 1e6], 1), (52, [1.5e6, 1e6], 2), (53, [1e3, 2e6], 3)]
    got = hn.mine(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_products_are_exact_up_to_64_bits():
    rows = np.array([[3.0, 4.0], [2.0 ** 40, 1.0], [2.0 ** 55, 3.0], [2.0 ** 200, 0.0], [-(2.0 ** 200), 0.0], [0.0, 2.0 ** 200]])
    assert whole_products(rows, np.array([7.0, 0.0])).tolist() == [21, 7 << 40, 7 << 55, (1 << 63) - 1, -(1 << 63), 0]
    assert whole_products(rows[:2], np.array([2.0 ** 22, 5.0])).tolist() == [(3 << 22) + 20, (1 << 62) + 5]
    assert whole_products(rows[:1], np.array([2.0 ** 62, -(2.0 ** 61)])).tolist() == [(3 << 62) - (4 << 61)]


def test_empty_table(spark, rows):
    assert hn.mine(table(spark, rows[:1]).limit(0)).count() == 0
    assert hn.mine(table(spark, [(0, [1.0], 1)])).count() == 0
