import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    """Each stage's input and output rows on the small table, with nulls, empty texts and repeated rows added."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    extra = [(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, None, None, None, None),
             (10**9 + 2, "123 456 !", "en", "s", 9)]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    docs = docs.unionAll(docs.limit(5))
    base = str(tmp_path_factory.mktemp("stages"))
    out, frame = [], docs
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, frame, sf_small).write.parquet(f"{base}/{i}")
        after = spark.read.parquet(f"{base}/{i}")
        out.append((frame.collect(), after.collect(), after.columns))
        frame = after
    return out


def test_columns(stages):
    for before, _, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_drops_letterless_texts_only(stages):
    before, after, _ = stages[0]
    letters = [r for r in before if re.search(r"[^\W\d_]", r.text or "")]
    assert sorted(map(str, letters)) == sorted(map(str, after))


def test_one_document_of_each_component(stages):
    before, after, _ = stages[1]
    prints = list({r.doc_id: brute.simhash(r.text) for r in before}.items())
    root = brute.components(prints)
    assert sorted(r.doc_id for r in after) == sorted(set(root.values()))


def test_repeated_passages(stages):
    before, after, _ = stages[2]
    want = brute.repeated_bytes([(r.doc_id, r.text) for r in before], 100)
    left = {r.doc_id: r for r in after}
    for d, (n, removed, spans, _) in want.items():
        assert (d in left) == (n > removed) or n - removed <= 6 * spans
        if d in left:
            assert left[d].n_chars == len(left[d].text)


def test_mixing_stage(stages):
    before, after, _ = stages[3]
    size = {r.doc_id: len(brute.words(r.text)) for r in before}
    taken = {}
    for r in after:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(brute.words(r.text))
    assert set(taken) <= set(size) and all(n <= 3 * size[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - sum(size.values())) <= 20      # half a word a source


def test_packing_stage(stages):
    before, after, _ = stages[4]
    seqs = {}
    for r in after:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert sum(r.length for r in after if r.start == 0) > 0


def test_empty_table(spark, sf_small):
    frame = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, sf_small)
        assert frame.count() == 0


def test_registered_queries():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries()


def clean_rows(messy):
    """Different long texts of which no two are near copies, by the brute force."""
    texts = [t for _, t in messy if t and len(t) > 500]
    root = brute.components([(i, brute.simhash(t)) for i, t in enumerate(texts)])
    return [t for i, t in enumerate(texts) if root[i] == i][:5]


def test_near_duplicates_choose_rows(spark, sf_small, messy):
    a, b, c, d, e = clean_rows(messy)
    rows = [(3, a), (7, a), (7, b), (7, b), (8, c), (8, d), (None, e), (None, d), (None, a), (None, b + " "), (None, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicate_stage(spark, docs, sf_small).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (7, b), (8, c), (8, d), (None, e)], key=str)


def test_null_and_repeated_ids_through_the_texts(spark, sf_small, messy):
    texts = clean_rows(messy)
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cut = pipeline.repeat_stage(spark, docs, sf_small)
    assert cut.columns == docs.columns and [r.doc_id for r in cut.collect()].count(None) == 2
    assert sum(len(r.text) for r in cut.collect()) > 0.5 * sum(map(len, texts))
    # one source is taken whole and once: the rows as they are, an equal row included
    mixed = pipeline.mixing_stage(spark, docs.unionAll(docs.limit(1)), sf_small)
    assert sorted(((r.doc_id, r.text) for r in mixed.collect()), key=str) == sorted(rows + rows[:1], key=str)


def test_extra_columns_of_any_name(spark, sf_small, messy):
    names = ("_own_id", "_id", "id", "row", "rest", "shard", "order_key", "size", "_text")
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(clean_rows(messy))],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
