import itertools

import numpy as np
import pytest

from quarry.llm.components import components
from quarry.llm.simhash import covering_masks, links, near_duplicates

from . import brute


def test_masks_cover_every_small_difference():
    rng = np.random.default_rng(0)
    masks = covering_masks(4, list(range(64)))
    for _ in range(3000):
        bits = rng.choice(64, 4, replace=False)
        differ = sum(1 << int(b) for b in bits)
        assert any(m & differ == 0 for m in masks)
    small = covering_masks(2, list(range(10)))
    for pair in itertools.combinations(range(10), 2):
        assert any(m & (1 << pair[0] | 1 << pair[1]) == 0 for m in small)


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_documents_match_brute_force(documents, messy, bucket_rows):
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in near_duplicates(documents, bucket_rows=bucket_rows).collect()}
    prints = [(d, brute.simhash(t)) for d, t in messy]
    root = brute.components(prints)
    assert got == {d: (f"{f:016x}", root[d]) for d, f in prints}


@pytest.mark.parametrize("bucket_rows", [4096, 8])
def test_links_join_all_near_fingerprints(spark, bucket_rows):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 12)
    prints = set()
    for s in seeds.tolist():        # clouds and chains of near fingerprints
        x = s
        for _ in range(25):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    e = links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), 4, bucket_rows)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(e).collect()}
    want = brute.components([(p, p) for p in prints])
    for a, b in itertools.combinations(prints, 2):
        assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b))


def test_chain_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(e.limit(0)).count() == 0


def test_repeated_rows_null_ids_and_empty_table(spark, empty):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (9, None), (8, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 7), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert near_duplicates(empty).count() == 0
