import math

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing
from quarry.llm.mixing import digest, mixed_documents, mixture, shard_pieces

from . import brute


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return fixed | {s: left * w[s] / total for s in free}
        for s in over:
            fixed[s] = float(cap * sizes[s])
        free -= over
        left = sum(sizes.values()) - sum(fixed.values())
    return fixed


@pytest.mark.parametrize("block", [1024, 7])
def test_targets_and_words_taken(documents, messy, block):
    got = {r.doc_id: r for r in digest(mixture(documents, block_words=block, shards=5)).collect()}
    size = {d: len(brute.words(t)) for d, t in messy}
    source = {d: ["a", "b", None][d % 3] for d, _ in messy}
    total = {s: sum(n for d, n in size.items() if source[d] == s) for s in ("a", "b", None)}
    want = shares(total)
    taken = dict.fromkeys(total, 0)
    for d, r in got.items():
        assert (r["size"], r.source_size) == (size[d], total[source[d]])
        assert math.isclose(r.target, want[source[d]], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[d]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in total)


def test_pieces_are_disjoint_and_reruns_agree(documents):
    a = mixture(documents, block_words=16, shards=4)
    b = mixture(documents.repartition(7), block_words=16, shards=4)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    spans = {}
    for r in shard_pieces(a).collect():
        assert 0 <= r["shard"] < 4
        spans.setdefault((r.doc_id, r.epoch), []).append((r.start, r.start + r.words))
    for parts in spans.values():
        parts.sort()
        assert all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))


def test_shards_get_equal_slots(documents):
    a = mixture(documents, block_words=4, shards=4)
    slots = a.select("source", F.inline("pieces")).select("source", "shard", "slot").distinct().groupBy("shard").count()
    counts = [r["count"] for r in slots.collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 3


def test_mixed_texts(documents, messy):
    mixed = mixed_documents(documents, block_words=8)
    assert mixed.columns == documents.columns
    taken = {r.doc_id: r.taken for r in digest(mixture(documents, block_words=8)).collect()}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.words(r.text))
    assert got == {d: n for d, n in taken.items() if n}


def test_hypergeometric_draws(spark):
    draw = mixing.hypergeometric_sql("50L", "20L", "10L", "(shiftrightunsigned(xxhash64(id), 11) / 9007199254740992D)")
    rows = spark.range(20000).select(F.expr(draw).alias("x")).groupBy("x").count().collect()
    for r in rows:
        p = math.comb(20, r.x) * math.comb(30, 10 - r.x) / math.comb(50, 10)
        assert abs(r["count"] / 20000 - p) < 5 * math.sqrt(p * (1 - p) / 20000) + 1e-4


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select(F.expr(mixing._permuted("id", f"{n}L", "5")).alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(n))


def test_quotas_split_exactly(spark):
    quotas = spark.createDataFrame([(1, 100), (2, 7), (3, 0), (4, 1000)], "rank int, slots bigint")
    for r in mixing.split_quotas(quotas, 6, 1).collect():
        assert r.starts[0] == 0 and r.starts == sorted(r.starts) and len(r.starts) == 6


def test_repeated_rows_and_empty_tables(spark, empty):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a", None), (2, None, "s")]
    got = digest(mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))).collect()
    assert len(got) == 4 and all(r.taken <= 3 * r["size"] for r in got)
    assert mixture(empty).count() == 0
    none = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in digest(mixture(none)).collect()] == [(0, 0.0, 0)] * 2


def test_shards_order_the_mix_and_take_the_same_words(documents):
    few, many = (digest(mixture(documents, block_words=8, shards=n)).collect() for n in (2, 8))
    assert sorted((r.doc_id, r.taken) for r in few) == sorted((r.doc_id, r.taken) for r in many)
    assert all(sum(s.words for s in r.shard_words) == r.taken for r in many)
    totals = {}
    for r in many:
        for s in r.shard_words:
            totals[s.shard] = totals.get(s.shard, 0) + s.words
    assert set(totals) == set(range(8)) and max(totals.values()) < 2 * min(totals.values())
    a, b = ([(r.doc_id, r.text) for r in mixed_documents(documents, block_words=8, shards=n).collect()] for n in (2, 8))
    assert a != b and sorted(map(str, a)) == sorted(map(str, b))


def test_many_null_and_equal_ids_keep_buckets_small(spark):
    # every word is taken once, wherever it stands; the order within the source shows no hot bucket
    rows = [(None if i % 3 else 5, f"w{i} " * (1 + i % 4), "s") for i in range(900)] + [(None, None, "s")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = digest(mixture(docs, block_words=16)).collect()
    assert len(got) == 1400 and all(r.taken == r["size"] for r in got)
