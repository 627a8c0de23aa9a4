import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id
from quarry.session import table


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    like, move = rng.random((5, 3)) + 0.1, rng.random((3, 3)) + 0.1
    which = np.array([0, 1, 2, 3, 4, 0, 2])
    first, size = np.array([0, 4, 4]), np.array([4, 0, 3])
    got, pairs = language_id.forward_backward(which, first, size, like, move, pairs=True)
    want, want_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, n in ((0, 4), (4, 3)):
        total, marg, two = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.prod([like[which[a + t], path[t]] for t in range(n)])
            p *= np.prod([move[path[t], path[t + 1]] for t in range(n - 1)])
            total += p
            for t in range(n):
                marg[t, path[t]] += p
                if t:
                    two[path[t - 1], path[t]] += p
        want[a:a + n], want_pairs = marg / total, want_pairs + two / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_code_switched_text_follows_the_switch():
    rng = random.Random(2)
    def run(letters, n):
        return [bytes(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n)]
    field = language_id.fit([("x", run(b"abcd", 20)) for _ in range(60)] + [("y", run(b"cdef", 20)) for _ in range(60)])
    text = b" ".join(run(b"abcd", 30) + run(b"cdef", 10)).decode()
    share = field.shares(pa.array([text, "", None, "123 !!"]).fill_null(""))
    assert abs(share[0][0] - 0.75) < 0.1 and not share[1:].any()


def test_held_out_accuracy(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    pred = language_id.predict(docs, language_id.learn(docs))
    got = pred.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.95


def test_messy_documents(documents, empty, messy):
    field = language_id.learn(documents, per_language=5)
    got = {r.doc_id: r for r in language_id.predict(documents, field).collect()}
    for d, text in messy:
        letters = any(c.isalpha() for c in text or "")
        assert (got[d].lang_pred == "und") == (not letters)
        assert 0 <= got[d].score <= 1
    assert language_id.predict(empty, field).count() == 0
    nothing = language_id.learn(empty)
    assert {r.lang_pred for r in language_id.predict(documents, nothing).collect()} == {"und"}


def test_only_text_is_used(documents):
    field = language_id.learn(documents, per_language=5)
    other = documents.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    a = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(documents, field).collect()}
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(other, field).collect()}


@pytest.mark.parametrize("word", ["É", "é", "Straße", "日本"])
def test_lower_keeps_utf8(word):
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    language_id.lower(data).tobytes().decode()
