"""Whole texts as flat NumPy arrays inside Arrow tasks: words, hashes, bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text worked on at once; a longer single text is still taken whole
SLICE_BYTES = 2 << 20

#: the six ASCII blanks 0x09-0x0D and 0x20 end a word; every other byte belongs to one
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_values(seed: int = 11) -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


_VALUES = byte_values()
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        one = np.ones(size, dtype=np.uint64)
        one[1:] = _BASE
        _POW = np.multiply.accumulate(one)
        one[1:] = _BASE_INV
        _INV = np.multiply.accumulate(one)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty texts."""
    return pc.fill_null(batch.column(name), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes.

    Yields (first row, end row, bytes of these rows, offsets of each row in them).
    """
    n = len(texts)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offs = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def word_spans(data: np.ndarray, offs: np.ndarray,
               parted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, end byte of each word, first word of each row and the total).

    ``parted`` marks bytes that begin a word of their own right after another.
    """
    if len(data) == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offs), dtype=np.int64)
    w = _WORD[data]
    head, tail = w.copy(), w.copy()
    head[1:] &= ~w[:-1]
    tail[:-1] &= ~w[1:]
    if parted is not None:
        head |= parted
        tail[:-1] |= parted[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    head[edge] = w[edge]
    tail[edge - 1] = w[edge - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hash` takes the hash of any range."""
    pow_, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * pow_[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each range [start, end); equal ranges hash alike wherever they stand."""
    _, inv = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts])


def gram_hash(prefix: np.ndarray, g: int) -> np.ndarray:
    """Mixed hash of every range of ``g`` consecutive symbols."""
    n = len(prefix) - g
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, inv = _powers(len(prefix))
    return mix((prefix[g:] - prefix[:-g]) * inv[:n])


def bytes_prefix(data: np.ndarray) -> np.ndarray:
    """:func:`prefix_hash` of bytes, each with its fixed random value."""
    return prefix_hash(_VALUES[data])
