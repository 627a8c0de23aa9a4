"""Windows of consecutive symbols that also occur earlier: the distributed part of both repeat operators.

A symbol is a byte or a word; a window is ``window`` consecutive symbols of one
document.  No step shuffles a window for each symbol:

1. *Sampling.* Every window names its least-hashed run of ``gram`` symbols (its
   anchor).  Equal windows name equal anchors at equal places, so a window whose
   anchor occurs once in the corpus is unique.  About one symbol in
   ``(window - gram) / 2`` starts an anchor; only (hash, place) is shuffled.
   An anchor that one batch meets often sends one row to its hash's partition
   and spreads the others, which are known to repeat.
2. *Contexts.* The text around each repeated anchor (all windows that name it)
   is cut out where the document is.
3. *Groups.* Contexts are dealt by their prefix, the anchor, and handed, in
   memory-sized chunks of whole groups, to the operator's own structure (suffix
   array or suffix tree), which says which windows have an earlier equal.
   Equal contexts are reduced to the earliest one inside each task before they
   are shuffled, and again in the group.  A group that still has more than
   ``hot_rows`` contexts (around a passage in a third of all documents) is
   passed on window by window: one more exchange deals those by their whole
   content, so that no task has to hold what merely touches a frequent anchor.
4. *Spans.* The windows found go back to their documents.

Hashes only decide what meets; what is equal is decided on the symbols
themselves.  A document's identity is its id and 47 bits of hash of its text, and
for a null id another 64 bits of the text's hash: rows with equal id and text are
one document (each row gets the same result).  Null ids come before all others.
Documents under one id, or under null, have no order among each other: neither
has an earlier window than the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from .textarrays import (bytes_prefix, gram_hash, mix, prefix_hash, slices, span_hash, text_column, word_spans)

#: text of contexts that is indexed at once
CHUNK_BYTES = 2 << 20
#: different contexts of one anchor that a group may hold
HOT_ROWS = 50_000
#: equal anchors that one batch sends to one partition
SPREAD_ROWS = 64
#: marks the identity of a row without an id
NULL_TIE = 1 << 47


def doc_order(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """What says which of two documents comes first: the id, or the least number for a null one."""
    return np.where(ties >= NULL_TIE, np.int64(-(1 << 63)), ids)


def window_anchors(grams: np.ndarray, offs: np.ndarray, window: int,
                   gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, whether the anchor moves) of each run of windows.

    ``grams`` are the hashes of the runs of ``gram`` symbols at each place of
    the concatenated rows, ``offs`` the rows' bounds in symbols.  A run is
    consecutive windows of one row with equal least hash, so that periodic text
    is one run.  Two equal windows have their least gram at equal offsets; if
    both lie in one run, the leftmost place of it moves within the run.
    """
    wide = window - gram + 1
    n = int(offs[-1]) - window + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(bool)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[:len(low) - (wide - span)], low[wide - span:])
    anchor = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, dtype=np.int32)
    bad_from, bad_to = np.minimum(np.maximum(offs[1:] - window + 1, offs[:-1]), n), np.minimum(offs[1:], n)
    np.add.at(edge, bad_from, 1)
    np.subtract.at(edge, bad_to, 1)
    valid = np.cumsum(edge[:-1]) == 0
    new = np.ones(n, dtype=bool)
    moves = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    new[1:] = ~valid[:-1]
    new[moves] |= grams[anchor[moves]] != grams[anchor[moves - 1]]
    new[offs[:-1][offs[:-1] < n]] = True
    lo = np.flatnonzero(new & valid)
    last = np.ones(n, dtype=bool)
    last[:-1] = new[1:] | ~valid[1:]
    hi = np.flatnonzero(last & valid)
    return anchor[lo], lo, hi - lo + 1, anchor[lo] != anchor[hi]


def _row_anchors(data, offs, window, gram, words):
    """Of all runs of a slice of rows: hash, row, whether it repeats in itself, first window, windows."""
    prefix = bytes_prefix(data)
    if words:
        starts, ends, offs = word_spans(data, offs)
        prefix = prefix_hash(span_hash(prefix, starts, ends))
    grams = gram_hash(prefix, gram)
    a, lo, n, moved = window_anchors(grams, offs, window, gram)
    row = np.searchsorted(offs, lo, side="right") - 1
    return grams[a], row, moved, lo - offs[row], n


#: packed columns of a sampled run: name, type, bytes kept.  48 bits of a hash
#: decide what may be equal; the symbols decide what is.
_FIELDS = (("hash", "<u8", 6), ("id", "<i8", 8), ("tie", "<u8", 6), ("lo", "<i8", 8), ("n", "<i4", 4), ("seen", "<i4", 4))


def _pack(x: np.ndarray, kind: str, width: int) -> bytes:
    """Bytes of an integer column, place by place, so that shuffle compression finds the equal high bytes."""
    planes = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return np.ascontiguousarray(planes[:width]).tobytes()


def _unpack(b: bytes, kind: str, width: int) -> np.ndarray:
    planes = np.frombuffer(b, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(kind).ravel()


def _sample(window: int, gram: int, words: bool, buckets: int, spread_rows: int):
    """Runs of each batch of documents, by bucket of their anchor's hash, as packed columns.

    ``seen`` is 1, or 2 for a run that repeats in itself.  Of an anchor that the
    batch has more than ``spread_rows`` times the first run stands for all; the
    others get 0 and go to any bucket: they are known to repeat.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            ties = batch.column("_tie").to_numpy(zero_copy_only=False)
            got = []
            for a, _, data, offs in slices(text_column(batch)):
                h, row, *rest = _row_anchors(data, offs, window, gram, words)
                got.append((h, row + a, *rest))
            if not got:
                continue
            h, row, moved, lo, n = (np.concatenate(x) for x in zip(*got))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            head = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            many = np.diff(np.append(head, len(h)))
            often = np.repeat(many > spread_rows, many)
            seen = np.empty(len(h), dtype=np.int32)
            seen[order] = np.where(often, 0, 1 + moved[order])
            seen[order[head[many > spread_rows]]] = many[many > spread_rows]
            spread = np.where(seen == 0, mix(h + np.arange(len(h), dtype=np.uint64)), mix(h))
            bucket = (spread % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            values = {"hash": h, "id": ids[row], "tie": ties[row], "lo": lo, "n": n, "seen": seen}
            parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[p[0]]) for p in parts], type=pa.int32())]
                + [pa.array([_pack(values[f][p], k, w) for p in parts], type=pa.binary()) for f, k, w in _FIELDS],
                names=["bucket"] + [f for f, _, _ in _FIELDS])
    return run


_RUNS = "hash bigint, _id bigint, _tie bigint, lo bigint, n int"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a partition whose anchors occur more than once."""
    cols: dict[str, list] = {f: [] for f, _, _ in _FIELDS}
    for batch in batches:
        for f, k, w in _FIELDS:
            cols[f].extend(_unpack(b.as_py(), k, w) for b in batch.column(f))
    if not cols["hash"]:
        return
    v = {f: np.concatenate(x) for f, x in cols.items()}
    held = np.flatnonzero(v["seen"] > 0)
    order = held[np.argsort(v["hash"][held], kind="stable")]
    h = v["hash"][order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(v["seen"][order].astype(np.int64), head) if len(h) else head
    keep = v["seen"] == 0
    keep[order[np.repeat(total > 1, np.diff(np.append(head, len(order))))]] = True
    for a in range(0, len(keep), 1 << 18):
        k = np.flatnonzero(keep[a:a + (1 << 18)]) + a
        yield pa.RecordBatch.from_arrays(
            [pa.array(v["hash"][k].view(np.int64)), pa.array(v["id"][k]), pa.array(v["tie"][k].astype(np.int64)),
             pa.array(v["lo"][k]), pa.array(v["n"][k])], names=["hash", "_id", "_tie", "lo", "n"])


_CONTEXT = "key bigint, _id bigint, _tie bigint, lo bigint, n bigint, context binary, copies array<bigint>"


def _context_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, (id, tie, lo), n, context, copies)."""
    for a in range(0, len(rows), 50_000):
        part = rows[a:a + 50_000]
        key = np.array([r[0] for r in part], dtype=np.uint64).view(np.int64)
        place = np.array([r[1] for r in part], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), *(pa.array(place[:, i]) for i in range(3)), pa.array([r[2] for r in part], type=pa.int64()),
             pa.array([r[3] for r in part], type=pa.binary()), pa.array([r[4] for r in part], type=pa.list_(pa.int64()))],
            names=["key", "_id", "_tie", "lo", "n", "context", "copies"])


def _anywhere(place: np.ndarray) -> np.ndarray:
    """Keys that spread rows which no group needs."""
    return mix(place[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place[:, 2].astype(np.uint64))


def _contexts(window: int, words: bool, other_documents: bool):
    """The text of each anchor's windows; equal ones of a batch only once, the later ones as found.

    Found rows have no context.  Where only other documents count, equal
    contexts of the document that is first are ``copies`` of its row: they
    stand or fall with it.
    """
    def cut(batch) -> Iterator[tuple]:
        ids, ties = batch.column("_id").to_pylist(), batch.column("_tie").to_pylist()
        anchors = batch.column("anchors")
        for a, b, data, offs in slices(text_column(batch)):
            if words:
                starts, ends, first = word_spans(data, offs)
            for d in range(a, b):
                if not anchors[d].is_valid:
                    continue
                key, lo, n = (c.to_numpy(zero_copy_only=False) for c in anchors[d].values.flatten())
                if words:
                    fits = lo + n + window - 2 < first[d - a + 1] - first[d - a]
                    key, lo, n = key[fits], lo[fits], n[fits]
                    begin, end = starts[first[d - a] + lo], ends[first[d - a] + lo + n + window - 2]
                else:
                    begin = offs[d - a] + lo
                    end = begin + n + window - 1
                # an identity that two texts share brings each the other's anchors too: what fits is looked at, the rest is not there
                last = ends[first[d - a + 1] - 1] if words and first[d - a + 1] > first[d - a] else offs[d - a + 1]
                for k, i, many, x, y in zip(key.view(np.uint64).tolist(), lo.tolist(), n.tolist(), begin.tolist(), end.tolist()):
                    if y > last:
                        continue
                    text = data[x:y].tobytes()
                    # blanks don't tell words apart
                    yield k, (ids[d], ties[d], i), many, b" ".join(text.split()) if words else text

    def order(place: tuple) -> int:
        return -(1 << 63) if place[1] >= NULL_TIE else place[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, tuple] = {}
            # places by document, where the best order has several
            peers: dict[bytes, dict[tuple, set]] = {}
            later: list[tuple] = []
            for key, place, n, text in cut(batch):
                old = best.get(text)
                if old is None:
                    best[text] = (place, n, key)
                    continue
                rank, least = order(place), order(old[0])
                if rank > least:
                    later.append((place, n))
                elif rank < least:
                    gone = peers.pop(text, None)
                    later.extend(((*d, x), n) for d, at in gone.items() for x in at) if gone else later.append((old[0], n))
                    best[text] = (place, n, key)
                elif place != old[0]:       # a place that is there already is that of an equal row
                    at = peers.setdefault(text, {old[0][:2]: {old[0][2]}}).setdefault(place[:2], set())
                    at.add(place[2])
                    if not other_documents and len(at) > 1:
                        later.append(((*place[:2], max(at)), n))
                        at.discard(max(at))
            rows = []
            for text, (place, n, key) in best.items():
                for doc, at in peers.get(text, {place[:2]: (place[2],)}).items():
                    at = sorted(at)
                    rows.append((key, (*doc, at[0]), n, text, at[1:] or None))
            yield from _context_rows(rows)
            if later:
                key = _anywhere(np.array([p for p, _ in later], dtype=np.int64)).tolist()
                yield from _context_rows([(k, place, n, None, None) for k, (place, n) in zip(key, later)])
    return run


Index = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def earlier_windows(contexts: list[bytes], places: np.ndarray, counts: np.ndarray, index: Index,
                    other_documents: bool) -> np.ndarray:
    """Rows (context, first window, windows) of the runs of windows that have an earlier equal in the chunk.

    ``places`` are (id, tie, lo) of each context.  ``index`` takes distinct
    contexts and their window counts and returns (context, window, class) of
    every window that shares its content with another; classes are equal
    content.  An earlier equal is one in a document of lower order (see
    :func:`doc_order`) or, without ``other_documents``, one before it in the same document.
    """
    rank = doc_order(places[:, 0], places[:, 1])
    order = np.lexsort((places[:, 2], places[:, 1], places[:, 0], rank))
    doc = places[order, :2]
    doc_rank = np.empty(len(order), dtype=np.int64)
    doc_rank[order] = np.cumsum(np.append(True, np.any(doc[1:] != doc[:-1], axis=1)))
    first: dict[bytes, int] = {}
    own: dict[tuple, int] = {}
    whole, kept = [], []
    for i in order.tolist():
        j = first.setdefault(contexts[i], i)
        if j == i:
            kept.append(i)
        elif rank[i] != rank[j]:
            whole.append(i)
        else:       # documents of one order don't come before each other
            j = j if doc_rank[i] == doc_rank[j] else own.setdefault((j, doc_rank[i]), i)
            if j == i or (other_documents and places[i, 2] != places[j, 2]):
                kept.append(i)
            elif places[i, 2] != places[j, 2]:
                whole.append(i)
    whole, kept = np.array(whole, dtype=np.int64), np.array(kept, dtype=np.int64)
    out = [np.stack([whole, np.zeros(len(whole), dtype=np.int64), counts[whole]], axis=1)]
    c, w, cls = index([contexts[i] for i in kept.tolist()], counts[kept])
    if len(c):
        c = kept[c]
        by = np.lexsort((places[c, 2] + w, doc_rank[c], cls))
        c, w, cls = c[by], w[by], cls[by]
        head = np.append(True, cls[1:] != cls[:-1])
        later = rank[c] != rank[c[head][np.cumsum(head) - 1]]
        if not other_documents:     # the first place of its own document; equal places stand or fall together
            head |= np.append(True, doc_rank[c][1:] != doc_rank[c][:-1])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            later |= places[c, 2] + w != places[c[lead], 2] + w[lead]
        c, w = c[later], w[later]
        by = np.lexsort((w, c))
        c, w = c[by], w[by]
        if len(c):
            head = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1] + 1)))
            out.append(np.stack([c[head], w[head], np.diff(np.append(head, len(c)))], axis=1))
    return np.concatenate(out)


def _windows(context: bytes, n: int, window: int, words: bool) -> Iterator[bytes]:
    """The ``n`` windows of a context."""
    if words:
        parts = context.split(b" ")
        yield from (b" ".join(parts[i:i + window]) for i in range(n))
    else:
        yield from (context[i:i + window] for i in range(n))


def _grouped(index: Index, chunk_bytes: int, other_documents: bool, window: int, words: bool, hot_rows: int | None):
    """Reads contexts sorted by key; gives the windows with an earlier equal, as rows without context.

    A key with more than ``hot_rows`` different contexts is passed on as
    single windows, keyed by their content.
    """
    def frame(places: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        where = np.stack([places[:, 0], places[:, 1], lo], axis=1)
        none = pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(_anywhere(where).view(np.int64)), *(pa.array(np.ascontiguousarray(where[:, i])) for i in range(3)),
             pa.array(n), *none], names=["key", "_id", "_tie", "lo", "n", "context", "copies"])

    class Held:
        """Contexts of whole keys, and of the key that is being read."""

        def __init__(self):
            self.keys, self.places = np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
            self.counts, self.contexts, self.copies = np.zeros(0, dtype=np.int64), [], {}

        def add(self, keys, places, counts, contexts, copies):
            base = len(self.contexts)
            self.copies.update((base + i, c) for i, c in copies)
            self.keys, self.places, self.counts = (np.concatenate(x) for x in (
                (self.keys, keys), (self.places, places), (self.counts, counts)))
            self.contexts += contexts

        def take(self, pick: np.ndarray):
            """Leave only the rows ``pick``."""
            self.keys, self.places, self.counts = self.keys[pick], self.places[pick], self.counts[pick]
            self.contexts = [self.contexts[i] for i in pick.tolist()]
            self.copies = {j: self.copies[i] for j, i in enumerate(pick.tolist()) if i in self.copies}

        def bytes(self) -> int:
            return sum(map(len, self.contexts))

        def found(self, index) -> Iterator[pa.RecordBatch]:
            got = earlier_windows(self.contexts, self.places, self.counts, index, other_documents)
            if len(got):
                yield frame(self.places[got[:, 0]], self.places[got[:, 0], 2] + got[:, 1], got[:, 2])
            more = [(*self.places[i, :2].tolist(), lo + a, b) for i, a, b in got.tolist() for lo in self.copies.get(i, ())]
            if more:
                m = np.array(more, dtype=np.int64)
                yield frame(m, m[:, 2], m[:, 3])
            self.gone = got[:, 0]

        def reduce(self) -> Iterator[pa.RecordBatch]:
            """Give what equals an earlier context and forget it."""
            none = np.zeros(0, dtype=np.int64)
            yield from self.found(lambda contexts, counts: (none, none, none))
            stay = np.ones(len(self.contexts), dtype=bool)
            stay[self.gone] = False
            self.take(np.flatnonzero(stay))

        def windows(self) -> Iterator[pa.RecordBatch]:
            """Every window as a context of its own."""
            for a in range(0, len(self.contexts), 2000):
                rows = []
                for i in range(a, min(a + 2000, len(self.contexts))):
                    d, t, lo = self.places[i].tolist()
                    for w, text in enumerate(_windows(self.contexts[i], int(self.counts[i]), window, words)):
                        key = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
                        rows.append((key, (d, t, lo + w), 1, text, [x + w for x in self.copies.get(i, ())] or None))
                yield from _context_rows(rows)
            self.__init__()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot, size = Held(), None, 0
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_tie", "lo")], axis=1)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            key = batch.column("key").to_numpy(zero_copy_only=False)
            there = np.asarray(batch.column("context").is_valid())
            if not there.all():
                yield frame(place[~there], place[~there, 2], n[~there])
            more = batch.column("copies").filter(pa.array(there))
            copies = [(i, more[i].as_py()) for i in np.flatnonzero(np.asarray(more.is_valid())).tolist()]
            contexts = batch.column("context").drop_null().to_pylist()
            size += sum(map(len, contexts))
            held.add(key[there], place[there], n[there], contexts, copies)
            if hot is not None:
                other = np.flatnonzero(held.keys != hot)
                cut = int(other[0]) if len(other) else len(held.keys)
                rest = Held()
                rest.__dict__.update(held.__dict__)
                rest.take(np.arange(cut, len(held.keys)))
                held.take(np.arange(cut))
                yield from held.reduce()
                yield from held.windows()
                held, hot, size = rest, hot if not len(other) else None, rest.bytes()
            if size < chunk_bytes or not len(held.keys):
                continue
            other = np.flatnonzero(held.keys != held.keys[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            last = Held()
            last.__dict__.update(held.__dict__)
            last.take(np.arange(cut, len(held.keys)))
            if cut:
                held.take(np.arange(cut))
                yield from held.found(index)
            held, size = last, last.bytes()
            if size >= chunk_bytes:
                yield from held.reduce()
                if hot_rows is not None and len(held.contexts) > hot_rows:
                    hot = held.keys[-1]
                    yield from held.windows()
                size = held.bytes()
        if held.contexts:
            yield from held.found(index)
    return run


def _identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("bigint")
    tie = F.shiftrightunsigned(F.xxhash64(text), 17) + F.when(id_.isNull(), NULL_TIE).otherwise(0)
    return docs.select(F.coalesce(id_, F.xxhash64(F.lit(1), text)).alias("_id"), tie.alias("_tie"),
                       id_.isNull().alias("null_id"), text.alias("text"),
                       F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c not in (id_col, text_col)])
                       .alias("carried"))


def identified(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(_id, _tie, null_id, text, [carried]): documents dealt once by identity, for both joins with them."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _identity(docs, id_col, text_col)
    return (rows if carry else rows.drop("carried")).repartition(partitions, "_id", "_tie")


def repeated_windows(docs: DataFrame, window: int, gram: int, words: bool, index: Index, id_col: str, text_col: str,
                     chunk_bytes: int = CHUNK_BYTES, hot_rows: int = HOT_ROWS,
                     other_documents: bool = False, carry: bool = False) -> DataFrame:
    """_id, null_id, text, carried (the other columns, on request) and ``runs``: (first window, windows) of a document's windows that have an earlier equal.

    Runs may overlap; null where there are none.  With ``other_documents`` only
    documents before count, else also earlier places of the same one.
    """
    base = identified(docs, id_col, text_col, carry)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sampled = _identity(docs, id_col, text_col).select("_id", "_tie", "text").mapInArrow(
        _sample(window, gram, words, buckets, SPREAD_ROWS), "bucket int, " + ", ".join(f"`{f}` binary" for f, _, _ in _FIELDS))
    anchors = sampled.repartitionById(buckets, F.col("bucket")).mapInArrow(_repeated, _RUNS)
    placed = anchors.groupBy("_id", "_tie").agg(F.collect_list(F.struct("hash", "lo", "n")).alias("anchors"))
    # the same columns as in the last join, so that both read one exchange
    both = base.join(placed.hint("shuffle_hash"), ["_id", "_tie"], "left")
    contexts = both.mapInArrow(_contexts(window, words, other_documents), _CONTEXT)
    # the second pass is for the windows of frequent anchors; what the first has found goes through
    for limit in (hot_rows, None):
        contexts = contexts.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(
            _grouped(index, chunk_bytes, other_documents, window, words, limit), _CONTEXT)
    spans = contexts.groupBy("_id", "_tie").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    return base.join(spans.hint("shuffle_hash"), ["_id", "_tie"], "left")


def covered(runs: pa.Scalar, window: int, length: int) -> np.ndarray:
    """Which of ``length`` symbols lie in a window of the runs."""
    if not runs.is_valid or not len(runs):
        return np.zeros(length, dtype=bool)
    f = runs.values.flatten()
    lo, n = f[0].to_numpy(zero_copy_only=False), f[1].to_numpy(zero_copy_only=False)
    edge = np.zeros(length + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(lo, length), 1)
    np.subtract.at(edge, np.minimum(lo + n - 1 + window, length), 1)
    return np.cumsum(edge[:-1]) > 0
