"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets a label; neighbouring labels are tied by learned
transitions, so that a short or ambiguous word takes the language around it and
text that switches languages is followed across the switch.  Emissions are
linear in hashed features of the lower-cased word: affixes (the n-grams at its
ends), inner byte n-grams, and the word itself (the lexicon).  Forward-backward
gives each word's label probabilities; a document's language is the one with
the largest expected share of its words, and that share is its score.

Training maximises the conditional likelihood of sequences spliced from
labelled documents of different languages.  It is fitted on a bounded sample
(``per_language`` documents of each language, ``segments`` runs of
``segment_words`` words from each) that tasks cut out and the driver receives.
Prediction reads every whole text in Arrow tasks: emissions once per distinct
word, the recursions for all documents of a slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textarrays import bytes_prefix, mix, slices, span_hash, text_column

PER_LANGUAGE = 400
SEGMENTS = 3
SEGMENT_WORDS = 24
DIMENSIONS = 1 << 17
UNDETERMINED = "und"
#: text labelled at once
LABEL_BYTES = 8 << 20
_GRAMS = (2, 3, 4, 5)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower-cased A-Z and Latin-1 letters of UTF-8 bytes."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        late = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][late] += 32
    return out


def letter_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row) of runs of ASCII letters and non-ASCII bytes of lower-cased text."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offs), dtype=np.int64)
    w = (data >= 128) | ((data >= 97) & (data <= 122))
    head, tail = w.copy(), w.copy()
    head[1:] &= ~w[:-1]
    tail[:-1] &= ~w[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    head[edge] = w[edge]
    tail[edge - 1] = w[edge - 1]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, offs)


def word_column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words alone as an Arrow binary column."""
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    letters = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts),
                                            [None, pa.py_buffer(at), pa.py_buffer(letters)])


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all words in a row, first feature of each word)."""
    n = len(words)
    offs = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + n + 1]
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offs[0]:offs[-1]] if n else np.zeros(0, dtype=np.uint8)
    offs = offs - offs[0] if n else np.zeros(1, dtype=np.int64)
    # every word between two blanks: n-grams that hold a blank are its affixes
    length = np.diff(offs) + 2
    end = np.cumsum(length)
    begin = end - length
    padded = np.full(int(length.sum()), 32, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offs))
    padded[np.arange(len(raw)) + 2 * owner + 1] = raw
    left = np.repeat(end, length) - np.arange(len(padded))      # bytes up to the word's end
    ids, of = [], []
    gram = padded.copy()
    for k in range(2, max(_GRAMS) + 1):
        gram = gram[:-1] | padded[k - 1:] << np.uint64(8 * (k - 1)) if len(gram) > 1 else gram[:0]
        ok = np.flatnonzero(left[:len(gram)] >= k)
        ids.append(mix(gram[ok] | np.uint64(k) << np.uint64(56)))
        of.append(np.searchsorted(begin, ok, side="right") - 1)
    if n:
        ids.append(mix(span_hash(bytes_prefix(raw), offs[:-1], offs[1:]) ^ np.uint64(0x5DEECE66D)))
        of.append(np.arange(n))
    ids, of = np.concatenate(ids), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (ids[order] % np.uint64(DIMENSIONS)).astype(np.int32), np.searchsorted(of[order], np.arange(n))


def forward_backward(which: np.ndarray, first: np.ndarray, size: np.ndarray, likelihood: np.ndarray,
                     transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of every word, and with ``pairs`` the expected label pairs.

    Sequence ``i`` holds words ``first[i] .. first[i] + size[i]``; word ``j``
    has the likelihoods of row ``which[j]``.  All sequences advance together,
    the longest kept in front.
    """
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    # sequences still running at each step
    running = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
    states = likelihood.shape[1]
    alpha = np.empty((len(which), states), dtype=likelihood.dtype)
    a = None
    for t in range(longest):
        at = first[:running[t]] + t
        e = likelihood[which[at]]
        a = e / states if a is None else (a[:len(at)] @ transition) * e
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    total = np.zeros((states, states)) if pairs else None
    b = np.ones((len(size), states), dtype=likelihood.dtype)
    back = transition.T.copy()
    for t in range(longest - 1, -1, -1):
        m = running[t]
        at = first[:m] + t
        here = b[:m]
        e = likelihood[which[at]] * here
        if pairs and t:
            prev = alpha[at - 1]
            joint = prev[:, :, None] * transition[None] * e[:, None, :]
            total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        p = alpha[at] * here
        p /= p.sum(axis=1, keepdims=True)
        alpha[at] = p
        before = e @ back
        b[:m] = before / before.sum(axis=1, keepdims=True)
    return alpha, total


@dataclass
class WordField:
    """Weights of the conditional random field: features x labels, label x next label."""

    labels: list[str]
    weights: np.ndarray
    transition: np.ndarray

    def emissions(self, words: pa.Array) -> np.ndarray:
        """Score of every label for each word, a few thousand words at a time."""
        out = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        for a in range(0, len(words), 1 << 14):
            ids, first = features(words.slice(a, 1 << 14))
            out[a:a + (1 << 14)] = np.add.reduceat(self.weights[ids], first, axis=0)
        return out

    def shares(self, texts: pa.Array) -> np.ndarray:
        """Expected share of each label among the words of each text; zeros for a text without words."""
        out = np.zeros((len(texts), len(self.labels)))
        move = np.exp(self.transition - self.transition.max()).astype(np.float32)
        for a, b, data, offs in slices(texts, LABEL_BYTES):
            data = lower(data)
            starts, ends, first = letter_words(data, offs)
            if not len(starts):
                continue
            coded = pc.dictionary_encode(word_column(data, starts, ends))
            which = coded.indices.to_numpy(zero_copy_only=False)
            score = self.emissions(coded.dictionary)
            like = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float32)
            like = np.maximum(like, np.float32(1e-12))
            size = np.diff(first)
            p, _ = forward_backward(which, first[:-1], size, like, move)
            full = np.flatnonzero(size)
            sums = np.add.reduceat(p, first[:-1][full], axis=0, dtype=np.float64)
            out[a + full] = sums / size[full, None]
        return out


def held_out(id_: Column) -> Column:
    """Whether a document is kept from training: the checksum of its id's text, a null id counting as empty."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(3)) == 1


def training_segments(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int,
                      segments: int, segment_words: int) -> DataFrame:
    """(lang, words): word runs cut at hashed places from about ``per_language`` labelled documents of each language."""
    ready = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(3)).alias("h"), F.col(text_col).alias("text"))
    # about twice as many as wanted by a hash threshold, so that no language's rows meet in one task;
    # one row for each label, and the model holds weights for every label: small enough to broadcast
    counts = ready.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count("*")).alias("share"))
    near = ready.join(F.broadcast(counts), "lang").where(
        F.shiftrightunsigned("h", 11) / float(1 << 53) <= F.col("share"))
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    some = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, runs = [], []
            for lang, h, (a, b, data, offs) in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(),
                                                   slices(text_column(batch), 0)):
                data = lower(data)
                starts, ends, _ = letter_words(data, offs)
                n = len(starts)
                for k in range(min(segments, -(-n // segment_words))):
                    at = (h + k * 0x9E3779B9) % max(1, n - segment_words + 1)
                    s, e = starts[at:at + segment_words], ends[at:at + segment_words]
                    langs.append(lang)
                    runs.append([data[i:j].tobytes() for i, j in zip(s, e)])
            yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(runs, type=pa.list_(pa.binary()))],
                                             names=["lang", "words"])

    return some.select("lang", "h", "text").mapInArrow(cut, "lang string, words array<binary>")


def fit(segments: list[tuple[str, list[bytes]]], rounds: int = 40, rate: float = 0.5, ridge: float = 1e-4,
        seed: int = 9) -> WordField:
    """Fit the field by gradient ascent (per-weight step sizes) on sequences spliced from labelled word runs.

    Half of the sequences keep one language, the others join two or three runs
    of any language, so that transitions learn how often text switches.
    """
    segments = sorted(segments)
    labels = sorted({lang for lang, _ in segments})
    if not labels:
        return WordField([], np.zeros((DIMENSIONS, 0), dtype=np.float32), np.zeros((0, 0)))
    number = {lang: i for i, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(segments))
    words, truth, size = [], [], []
    at = 0
    while at < len(order):
        take = 1 if rng.random() < 0.5 else int(rng.integers(2, 4))
        part = [segments[i] for i in order[at:at + take]]
        at += take
        words += [w for _, run in part for w in run]
        truth += [number[lang] for lang, run in part for _ in run]
        size.append(sum(len(run) for _, run in part))
    size = np.array(size, dtype=np.int64)
    truth = np.array(truth, dtype=np.int64)
    first = np.cumsum(size) - size
    coded = pc.dictionary_encode(pa.array(words, type=pa.large_binary()))
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, begin = features(coded.dictionary)
    kinds, states = len(coded.dictionary), len(labels)
    owner = np.repeat(np.arange(kinds), np.diff(np.append(begin, len(ids))))
    seen = np.stack([np.bincount(which[truth == k], minlength=kinds) for k in range(states)], axis=1)
    inside = np.ones(len(which), dtype=bool)
    inside[first] = False
    nxt = np.flatnonzero(inside)
    seen_pairs = np.zeros((states, states))
    np.add.at(seen_pairs, (truth[nxt - 1], truth[nxt]), 1)
    weights, move = np.zeros((DIMENSIONS, states)), np.zeros((states, states))
    w2, m2 = np.full_like(weights, 1e-8), np.full_like(move, 1e-8)
    n = len(which)
    for _ in range(rounds):
        score = np.add.reduceat(weights[ids], begin, axis=0)
        like = np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-12)
        p, pairs = forward_backward(which, first, size, like, np.exp(move - move.max()), pairs=True)
        expected = np.stack([np.bincount(which, weights=p[:, k], minlength=kinds) for k in range(states)], axis=1)
        by_word = (seen - expected) / n
        grad = np.stack([np.bincount(ids, weights=by_word[owner, k], minlength=DIMENSIONS) for k in range(states)], axis=1)
        grad -= ridge / n * weights
        w2 += grad * grad
        weights += rate * grad / np.sqrt(w2)
        step = (seen_pairs - pairs) / n
        m2 += step * step
        move += rate * step / np.sqrt(m2)
    return WordField(labels, weights.astype(np.float32), move)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, segments: int = SEGMENTS, segment_words: int = SEGMENT_WORDS) -> WordField:
    """Fit on the bounded sample of the documents that are not held out."""
    rows = training_segments(docs, id_col, text_col, lang_col, per_language, segments, segment_words).collect()
    return fit([(r["lang"], [bytes(w) for w in r["words"]]) for r in rows])


def with_language(docs: DataFrame, field: WordField, text_col: str = "text",
                  carry: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score): every row (its ``carry`` columns, all by default) as a struct with its prediction."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    labels = np.array(field.labels + [UNDETERMINED], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.asarray(batch.column("letters"))
            # the text travels once: inside the row where that holds it
            texts = (pc.fill_null(pc.struct_field(batch.column("row"), text_col), "") if text_col in carry
                     else text_column(batch))
            share = field.shares(texts) if len(labels) > 1 else np.zeros((batch.num_rows, 1))
            best, score = share.argmax(axis=1), share.max(axis=1)
            none = ~letters | (score <= 0)
            best[none], score[none] = len(labels) - 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(labels[best], type=pa.string()), pa.array(np.minimum(score, 1.0))],
                names=["row", "lang_pred", "score"])

    text = F.col(text_col)
    carry = docs.columns if carry is None else carry
    out = StructType([StructField("row", docs.select(*carry).schema), StructField("lang_pred", StringType()),
                      StructField("score", DoubleType())])
    return docs.select(F.struct(*[docs[c] for c in carry]).alias("row"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
                       *([] if text_col in carry else [text.alias("text")])).mapInArrow(run, out)


def predict(docs: DataFrame, field: WordField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every document; only the text is used.

    A text that is null or has no letter, or any text when nothing was learned,
    is ``und`` with score 0.  Ties go to the label first in order.  Repeated
    rows are labelled each; an empty table gives no rows.
    """
    return with_language(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), field, carry=["id"]).select(
        F.col("row.id").alias(id_col), held_out(F.col("row.id")).alias("held_out"), "lang_pred", "score")
