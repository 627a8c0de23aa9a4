"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Every document becomes its token ids and an end id.  Whole sequences are cut
off its front; what remains (less than one sequence) is packed first-fit
decreasing, independently in random groups of documents, so that a group's
work and memory are bounded while all groups run at once.  The tournament tree
holds the free room of each open bin; the first bin with enough room is found
from the root in logarithmic time.

Token ids never leave the task that made them: what is shuffled is a length
and a checksum for each piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import slices, text_column, word_spans

SEQUENCE = 2048
#: documents in a random group: enough for a fit within a fraction of a percent
GROUP_DOCS = 4096
#: text whose distinct words are tokenised together
VOCABULARY_BYTES = 8 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of what is tokenised by itself, and the first part of each row.

    Besides blanks, a stop or comma after an ASCII letter begins a part: the
    tokenizer's pattern always parts there.  Capitals of A-Z are lowered as its
    normaliser does, unless a special token may stand in the slice.
    """
    parted = np.zeros(len(data), dtype=bool)
    if len(data):
        parted[1:] = _LETTER[data[:-1]] & ((data[1:] == 46) | (data[1:] == 44))
    starts, ends, first = word_spans(data, offs, parted)
    if not ((data[:-1] == 60) & (data[1:] == 124)).any():
        data = _LOWER[data]
    return data, starts, ends, first


_TOKENS: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    """One tokenizer for all tasks of a worker."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


class WordTokens:
    """Token ids of whole texts from the ids of their distinct blank-separated words.

    The tokenizer's pattern never joins characters across a blank and its
    normaliser changes no character next to one, so that a text's ids are the
    ids of its words, one after the other.  Distinct words are encoded a few
    hundred a call; the offsets tell which ids belong to which word.  Up to
    ``KNOWN_WORDS`` words stay known from one slice of text to the next.
    """

    KNOWN_WORDS = 1 << 19

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known = pa.array([], type=pa.large_string())
        self.known_ids, self.known_counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        ids, counts = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(words), 512):
            some = words[a:a + 512]
            code = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            first = np.cumsum([0] + [len(w) + 1 for w in some[:-1]])
            ids.append(np.array(code.ids, dtype=np.uint32))
            at = np.array([o[0] for o in code.offsets], dtype=np.int64)
            counts.append(np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each word, number of ids of each word) of distinct words."""
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(place))
        ids, counts = self._encode(new.to_pylist())
        ids = np.concatenate([self.known_ids, ids])
        counts = np.concatenate([self.known_counts, counts])
        rank = place.to_numpy(zero_copy_only=False)
        unseen = np.isnan(rank) if rank.dtype.kind == "f" else np.zeros(len(rank), dtype=bool)
        where = np.where(unseen, 0, rank).astype(np.int64)
        where[unseen] = len(self.known) + np.arange(len(new))
        first = np.cumsum(counts) - counts
        if len(counts) <= self.KNOWN_WORDS:
            self.known = pa.concat_arrays([self.known, new])
            self.known_ids, self.known_counts = ids, counts
        return ids, first[where], counts[where]

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, in order."""
        for a, b, data, offs in slices(texts, VOCABULARY_BYTES):
            data, starts, ends, first = _parts(data, offs)
            lengths = ends - starts
            # the words alone, as an Arrow column over a copy without the blanks
            at = np.zeros(len(starts) + 1, dtype=np.int64)
            np.cumsum(lengths, out=at[1:])
            inside = np.zeros(len(data) + 1, dtype=np.int8)
            inside[starts] += 1
            inside[ends] -= 1
            letters = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
            column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(letters))
            coded = pc.dictionary_encode(column)
            which = coded.indices.to_numpy(zero_copy_only=False)
            ids, begin, counts = self.words(coded.dictionary)
            for d in range(b - a):
                w = which[first[d]:first[d + 1]]
                n = counts[w]
                total = int(n.sum())
                if not total:
                    yield np.zeros(0, dtype=np.uint32)
                    continue
                # position of each id: its word's first id and the place within the word
                step = np.ones(total, dtype=np.int64)
                w, n = w[n > 0], n[n > 0]
                heads = np.concatenate(([0], np.cumsum(n)[:-1]))
                step[heads] = begin[w]
                step[heads[1:]] -= begin[w[:-1]] + n[:-1] - 1
                yield ids[np.cumsum(step)]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_tokens, crcs): tokens of each whole text with its end id, and the checksum of each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer_path)
        for batch in batches:
            total, crcs = [], []
            for ids in tokens.texts(text_column(batch)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                total.append(len(ids))
                crcs.append([zlib.crc32(ids[s:s + length].tobytes()) for s in range(0, len(ids), length)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(total, type=pa.int64()), pa.array(crcs, type=pa.list_(pa.int64()))],
                names=["id", "doc_tokens", "crcs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, doc_tokens bigint, crcs array<bigint>")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, offset in the bin, number of bins); items no longer than ``capacity``.

    Items are taken from the longest, equal ones in the given order; each goes
    to the first bin with room, found in a tournament tree whose inner nodes
    hold the larger free room of their two children.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return bins, offsets, 0
    leaves = 1 << (n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        b = node - leaves
        bins[i], offsets[i] = b, capacity - room[node]
        used = max(used, b + 1)
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets, used


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end_id: int = 1,
         group_docs: int = GROUP_DOCS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece; sequences are filled
    gaplessly from offset 0.  Null and empty texts are the end id alone.
    Repeated rows are packed once each; null ids are packed like any other, in
    groups that follow their place in the input; an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer_path, end_id, length, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    groups = max(1, -(-docs.count() // group_docs))
    schema = (f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        total = group.column("doc_tokens").to_numpy()
        crcs = group.column("crcs").combine_chunks()
        # equal input in any order gives equal packing
        order = np.lexsort((np.array([c[0] for c in crcs.to_pylist()], dtype=np.int64), total,
                            group.column("id").fill_null(0).to_numpy()))
        group, total, crcs = group.take(pa.array(order)), total[order], crcs.take(pa.array(order))
        whole = total // length
        rest = total - whole * length
        item = np.flatnonzero(rest)
        bins, offs, used = first_fit_decreasing(rest[item], length)
        count = whole + (rest > 0)
        doc = np.repeat(np.arange(len(total)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(length, total[doc] - nth * length)
        tail = np.zeros(len(total), dtype=np.int64)
        tail_off = np.zeros(len(total), dtype=np.int64)
        tail[item], tail_off[item] = bins, offs
        is_tail = nth == whole[doc]
        seq = np.where(is_tail, tail[doc], used + np.cumsum(~is_tail) - 1) + (key[0].as_py() << 32)
        return pa.Table.from_arrays(
            [group.column("id").take(pa.array(doc)), pa.array(nth * length), pa.array(size),
             crcs.flatten(), pa.array(total[doc]), pa.array(seq), pa.array(np.where(is_tail, tail_off[doc], 0))],
            names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # null and repeated ids are dealt by what they hold, rows without an id also by their place in the input
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    return (pieces.withColumn("g", F.pmod(F.xxhash64("id", "doc_tokens", "crcs", place, F.lit(seed)), F.lit(groups)))
            .groupBy("g").applyInArrow(run, schema))
