import hashlib
import re

import duckdb
import pytest

from quarry.llm import fill_in_middle as fim


def plain(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = [m.group() for m in re.finditer(fim.UNIT, text)]
    assert "".join(units) == text
    n = len(units)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


MARKED = ["a <P> b", "x<S>", "<M>", "a <P b> <S c <<M", "<S", "P> <", "a\x1cb c d", " lead", "trail \n\t", "👍 é 👍👍 z"]


@pytest.fixture(scope="module")
def rows(messy):
    extra = [(1000 + i, t) for i, t in enumerate(MARKED * 12)] + [(None, "no id here"), (5, "same id other text"),
                                                                 (5, "same id other text"), (-7, "minus")]
    return messy + extra


def test_digest_matches_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, 3, "c") for d, t in rows], "doc_id bigint, text string, n int, form string")
    made = fim.fill_in_middle(docs)
    want = [(d, *plain(d, t)) for d, t in rows]
    assert sorted(map(repr, (tuple(r) for r in made.collect()))) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    got = fim.digest(made).collect()
    again = [(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, again))


def test_sql_matches_brute_force(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id bigint, text varchar)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = [(d, *(w := plain(d, t))[:4], sha(w[4]), sha(t or "")) for d, t in rows]
    assert sorted(map(repr, con.execute(fim.oracle_sql()).fetchall())) == sorted(map(repr, want))


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_slices_end_where_units_end(messy, limit):
    for text in [t or "" for _, t in messy] + MARKED:
        assert fim.unit_ends(text, limit) == [m.end() for m in re.finditer(fim.UNIT, text)]


def test_very_long_texts():
    long = "word \n" * 700_000
    assert len(fim.unit_ends(long)) == 700_001
    assert fim.unit_ends(" " * 3_000_000) == [3_000_000]
    assert fim.unit_ends("x" * 3_000_000) == [3_000_000]


def test_empty_table(empty):
    assert fim.digest(fim.fill_in_middle(empty)).count() == 0
