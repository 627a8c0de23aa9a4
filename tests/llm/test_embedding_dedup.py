import duckdb
import numpy as np
import pytest

from quarry.llm import embedding_dedup as ed

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, v string, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "k", "v", 1)
                                  for i, v in rows], SCHEMA)


def brute(rows, threshold=0.9):
    """id -> (n_links, component_id, kept); ids are different."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    near = {i: set() for i, _ in rows}
    for d in {len(v) for _, v in good}:
        ids = [i for i, v in good if len(v) == d]
        x = np.stack([v for _, v in good if len(v) == d])
        n = np.linalg.norm(x, axis=1)
        for a, b in zip(*np.nonzero((x @ x.T) / np.outer(n, n) >= threshold)):
            if a != b:
                near[ids[a]].add(ids[b])
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((30, 32))
    near = centre[rng.integers(0, 30, 900)] + rng.uniform(0.05, 0.5, (900, 1)) * rng.standard_normal((900, 32))
    x = np.concatenate([rng.standard_normal((900, 32)), near, near[:60], near[:60] * 3])
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]


@pytest.mark.parametrize("list_rows,shard_rows", [(256, 8192), (64, 150), (1024, 100)])
def test_recall_and_no_false_links(spark, rows, list_rows, shard_rows):
    got = {r.vec_id: r for r in ed.near_duplicates(table(spark, rows), list_rows=list_rows, shard_rows=shard_rows).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[i].n_links <= want[i][0] and got[i].component_id >= want[i][1] for i in want)
    assert all(got[i].kept == (got[i].component_id == i) for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_equal_to_brute_force_with_every_border(spark, rows):
    # sqrt(d) steps of the mean square are the whole distance: then no list can be missed
    found = ed.near_duplicates(table(spark, rows), reach=32 ** 0.5, list_rows=40, shard_rows=120).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute(rows)


def test_sql_is_the_exact_answer(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id bigint, embedding float[])")
    some = rows[:700] + [(9000, None), (9001, [0.0] * 32), (9002, [1.0, None]), (9003, [float("nan")]), (9004, [])]
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", some)
    assert {r[0]: r[1:] for r in con.execute(ed.oracle_sql()).fetchall()} == brute(some)


def test_hot_groups_ties_and_invalid_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    same = [(i, base) for i in range(100, 300)]
    close = [(i, base + 0.02 * rng.standard_normal(16)) for i in range(300, 600)]
    odd = [(1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] * 16), (5, [float("inf")] * 16), (6, [None] * 16),
           (7, [1.0]), (8, [2.0]), (9, [-1.0]), (10, base * 1e30), (11, base * 1e-30)]
    rows = same + close + odd
    found = ed.near_duplicates(table(spark, rows), list_rows=64, shard_rows=50).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute(rows)


def test_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    found = ed.near_duplicates(table(spark, [(5, v), (5, v), (None, v), (None, w), (None, None), (7, [1.0, 0.01])])).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [
        (5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, False), (7, 3, 5, False), (None, 0, None, True), (None, 0, None, True)]))


def test_empty_table_and_one_row(spark):
    assert ed.near_duplicates(table(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert list(map(tuple, ed.near_duplicates(table(spark, [(1, [1.0])])).collect())) == [(1, 0, 1, True)]


def test_lists_share_shards_and_long_ones_are_split():
    got = ed.shards_of_lists([(3, 0, 10), (3, 1, 50), (3, 2, 45), (3, 3, 250), (3, 4, 5), (4, 0, 1)], 100)
    assert got == {(3, 0): (0, 1), (3, 1): (0, 1), (3, 2): (1, 1), (3, 3): (2, 3), (3, 4): (5, 1), (4, 0): (6, 1)}
