import textwrap

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.llm import license_scan


def test_matches_duckdb(spark, sf_small):
    got = entry.queries()["op3_license_scan"](spark, sf_small).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    want = con.execute(entry.oracle_sql()["op3_license_scan"]).df().sort_values("doc_id")
    for c in want.columns:
        assert [x if x == x else None for x in got[c]] == [x if x == x else None for x in want[c]], c


def test_units_and_bounds(spark):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 200)
    lines = mit.replace(", ", ",\n")
    rows = [(1, "words before\nReleased under the MIT License.\nwords after"), (2, mit.upper()), (3, lines),
            (4, "intro of a file\n\n" + lines + "\n\nand code"), (5, "Released under the MIT License and more words here"),
            (6, None), (7, ""), (8, "MIT"), (9, mit[:200]), (None, "licensed  under the\tMIT license")]
    docs = spark.createDataFrame([(d, t, "n", 0.5) for d, t in rows], "doc_id bigint, text string, license string, score double")
    got = {r.doc_id: (r.license, r.n_licenses) for r in license_scan.scan(docs).collect()}
    assert got == {1: ("MIT", 1), 2: ("MIT", 1), 3: ("MIT", 1), 4: ("MIT", 1), 5: (None, 0), 6: (None, 0), 7: (None, 0),
                   8: (None, 0), 9: (None, 0), None: ("MIT", 1)}


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_equals_plain_comparison(documents, messy, threshold):
    words = next(t for _, t in messy if t and len(t) > 600)
    templates = (("one", words[:200]), ("two", "same same same same"), ("three", words[100:400]))
    got = {r.doc_id: r.licenses for r in license_scan.scan(documents, templates, threshold, long=30).collect()}
    for d, text in messy:
        text = (text or "").encode()
        paras = license_scan._BLANK_LINES.split(text)
        units = [(u, 0) for u in text.split(b"\n") + paras + [text]]
        units += [(b" ".join(paras[i:i + k]), 30) for k in range(2, license_scan.RUN + 1) for i in range(len(paras) - k + 1)]
        want = set()
        for unit, least in units:
            a = license_scan.bigrams(unit)
            for name, t in templates:
                b = license_scan.bigrams(t.encode())
                if a and len(b) >= least and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                    want.add(name)
        assert got[d] == sorted(want)


@pytest.mark.parametrize("name", ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT"])
def test_notice_of_several_paragraphs_among_other_words(spark, name):
    notice = max((t for n, t in license_scan.TEMPLATES if n == name), key=len)
    other = " ".join(f"word{i}" for i in range(240))
    parts = notice.replace(": ", ":\n\n").replace(". ", ".\n\n")
    assert len(license_scan._BLANK_LINES.split(parts.encode())) > 1
    held = f"{other}\n\n{parts}\n\n{other}"
    wrapped = textwrap.fill(notice, 60)
    docs = spark.createDataFrame([(1, notice), (2, held), (3, f"{other}\n \n{wrapped}\n\n{other}"), (4, f"{other}\n\n{other}")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.score) for r in license_scan.scan(docs).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [name, name, name, None]
    assert got[1][1] == 1.0


def test_empty_table(empty):
    assert license_scan.scan(empty).count() == 0
