import random

import pytest


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """(doc_id, text): copies, shared passages, periodic and empty texts, nulls, blanks of every kind, long texts."""
    rng = random.Random(4)
    passage = sentence(rng, 40)
    base = [sentence(rng, 120) for _ in range(6)]
    texts = [*base, base[0], base[0], base[1][:300] + " changed " + base[1][300:], None, "", " \t\n", "word", "word",
             "same same same " * 60, "ab" * 400, "\x0b".join(base[2].split()), base[3].upper(),
             sentence(rng, 20) + " " + passage + " " + sentence(rng, 20),
             passage + "\n" + sentence(rng, 30), sentence(rng, 5) + "  " + passage,
             "é" * 150 + sentence(rng, 30), "x" + "é" * 150, sentence(rng, 6000), "a b\x1cc " * 30]
    ids = list(range(3, 3 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.fixture(scope="session")
def documents(spark, messy):
    """The messy texts as documents, with null sources and languages and a column of a clashing name."""
    rows = [(d, t, ["en", None, "de"][d % 3], ["a", "b", None][d % 3], len(t or ""), "x", d, 1.5) for d, t in messy]
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, _id bigint, "
              "size double")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
