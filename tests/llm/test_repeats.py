import random
import zlib

import numpy as np
import pytest

from quarry.llm import repeats, suffix_array, suffix_tree

from . import brute


@pytest.mark.parametrize("recurse", [0, 1024])
def test_suffix_array_is_sorted(monkeypatch, recurse):
    monkeypatch.setattr(suffix_array, "RECURSE_NAMES", recurse)
    rng = random.Random(recurse)
    for n in [0, 1, 2, 3, *(rng.randint(4, 80) for _ in range(150))]:
        kinds = rng.randint(1, 4)
        s = [rng.randint(1, kinds) for _ in range(n)] + [0]
        assert suffix_array.suffix_array(np.array(s), kinds + 1).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_substrings_that_begin_others():
    rng = random.Random(9)
    parts = [[rng.randint(1, 4) for _ in range(rng.randint(1, 40))] for _ in range(60)]
    s = [x for _ in range(300) for x in rng.choice(parts)] + [0]
    want = suffix_array._doubled(np.array(s)).tolist()
    assert suffix_array.suffix_array(np.array(s), 5).tolist() == want
    assert suffix_array.suffix_array(np.array(s), 300).tolist() == want      # by induced names


def test_runs_and_periods_of_any_length():
    for period in (b"a", b"ab", b"aabab"):
        text = period * (200_000 // len(period)) + b"b" + period * 50
        contexts, counts = [text], np.array([len(text) - 99])
        c, w, cls = suffix_array.shared_windows(contexts, counts, 100)
        groups = {}
        for i, k in zip(w.tolist(), cls.tolist()):
            groups.setdefault(k, set()).add(text[i:i + 100])
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)
        seen, twice = set(), set()
        for i in range(len(text) - 99):
            (twice if text[i:i + 100] in seen else seen).add(text[i:i + 100])
        assert {text[i:i + 100] for i in w.tolist()} == twice


def test_common_prefixes():
    text = b"banana banana bananx"
    s = np.append(np.frombuffer(text, dtype=np.uint8).astype(np.int64), 0)
    sa = suffix_array.suffix_array(s, 256)[1:]
    got = suffix_array.permuted_common_prefixes(text, sa, 9)
    for i in range(1, len(sa)):
        a, b = text[sa[i - 1]:] + b"\0", text[sa[i]:] + b"\0"
        n = next(k for k in range(len(a) + 1) if a[k:k + 1] != b[k:k + 1] or k >= len(b))
        assert got[i] == min(9, n)


@pytest.mark.parametrize("hot_rows,chunk,spread", [(50_000, 2 << 20, 64), (1, 100, 64), (3, 200, 1)])
def test_bytes_match_brute_force(monkeypatch, documents, messy, hot_rows, chunk, spread):
    monkeypatch.setattr(repeats, "SPREAD_ROWS", spread)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_array.remove_repeats(documents, hot_rows=hot_rows, chunk_bytes=chunk).collect()}
    assert got == brute.repeated_bytes(messy, 100)


@pytest.mark.parametrize("hot_rows,chunk,spread", [(50_000, 2 << 20, 64), (1, 100, 64), (3, 200, 1)])
def test_words_match_brute_force(monkeypatch, documents, messy, hot_rows, chunk, spread):
    monkeypatch.setattr(repeats, "SPREAD_ROWS", spread)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in suffix_tree.remove_repeats(documents, hot_rows=hot_rows, chunk_bytes=chunk).collect()}
    assert got == brute.repeated_words(messy, 13)


def same_crc(head):
    """Two different texts with one CRC-32."""
    seen, rng = {}, random.Random(1)
    while True:
        text = f"{head} tail {rng.random()}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            return other, text


@pytest.mark.parametrize("operator,size", [(suffix_array, 100), (suffix_tree, 13)])
@pytest.mark.parametrize("hot_rows,chunk", [(50_000, 2 << 20), (1, 100)])
def test_repeated_rows_null_ids_and_texts_under_one_id(spark, operator, size, hot_rows, chunk):
    rng = random.Random(6)
    shared, other = (" ".join(str(rng.random()) for _ in range(40)) for _ in range(2))
    a, b = same_crc(shared)
    c, d = same_crc(other)
    rows = [(1, shared), (1, shared), (1, shared + " x " + other), (1, other + " and " + other), (2, shared), (2, None),
            (None, a), (None, b + " long " * 200), (None, a), (7, c), (7, d), (7, "short"), (0, other[:400]), (9, other)]
    plain = brute.repeated_bytes_rows if operator is suffix_array else brute.repeated_words_rows
    want = [(i, *x) for (i, _), x in zip(rows, plain(rows, size))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for some in (docs, docs.coalesce(1)):
        found = operator.remove_repeats(some, hot_rows=hot_rows, chunk_bytes=chunk).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    # without a null id that has the passage, nothing comes before id 1
    rows = rows[:6]
    want = [(i, *x) for (i, _), x in zip(rows, plain(rows, size))]
    found = operator.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_empty_table(empty):
    assert suffix_array.remove_repeats(empty).count() == 0
    assert suffix_tree.remove_repeats(empty).count() == 0
    assert suffix_array.without_repeats(empty).columns == empty.columns


def test_texts_without_repeats(documents, messy):
    kept = {r.doc_id: r for r in suffix_array.without_repeats(documents).collect()}
    assert set(kept) == {d for d, _ in messy}
    sizes = brute.repeated_bytes(messy, 100)
    for d, text in messy:
        left = sizes[d][0] - sizes[d][1]
        assert left - 6 * sizes[d][2] <= len(kept[d].text.encode()) <= left     # cut characters go whole
        assert (kept[d].hash, kept[d]["size"], kept[d]._id) == ("x", 1.5, d)
