import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm.packing import WordTokens, first_fit_decreasing, pack

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
HARD = ["", "Don't we'll  X, Y. z <|endoftext|> a<|startoftext|>b <|EndOfText|>", "ΑΣΟΣ ΣΣ\u0085q é ́x\x1cy", "İstanbul ​ ﬁ",
        "a\x00b c　d", "'S 'lL x'd. y., z.a,b", "ﬁ.x É. 'T.it's", "x" * 5000, " \t\r\n", "1234 ½ ٣"]


def test_ids_equal_the_tokenizer(messy):
    plain = tokenizers.Tokenizer.from_file(PATH)
    texts = HARD + [t or "" for _, t in messy]
    own = WordTokens(PATH)
    for _ in range(2):      # the second time from known words
        for text, ids in zip(texts, own.texts(pa.array(texts))):
            assert plain.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(3)
    for n in (0, 1, 5, 200):
        sizes = np.array([rng.randint(1, 100) for _ in range(n)], dtype=np.int64)
        bins, offsets, used = first_fit_decreasing(sizes, 100)
        room, want = [], np.zeros(n, dtype=np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            want[i] = b
            assert offsets[i] == 100 - room[b]
            room[b] -= sizes[i]
        assert bins.tolist() == want.tolist() and used == len(room)


@pytest.mark.parametrize("group", [4096, 4])
def test_pieces_round_trip(documents, messy, group):
    plain = tokenizers.Tokenizer.from_file(PATH)
    rows = pack(documents, PATH, length=256, group_docs=group).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, text in messy:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 256


def test_repeated_rows_null_ids_and_empty_table(spark, empty):
    rows = [(1, "a b"), (1, "a b"), (None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 3), (1, 3)]
    assert pack(empty, PATH).count() == 0


def test_null_and_repeated_ids_don_t_share_a_group(spark):
    rows = [(None, None)] * 1500 + [(7, f"text number {i}") for i in range(1500)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), PATH, group_docs=100).collect()
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert sum(groups.values()) == 3000 and len(groups) == 30 and max(groups.values()) < 200
