"""Repeated word sequences through prefix-partitioned suffix trees.

Suffixes are split by variable-length prefixes into groups that fit in memory:
the prefix is the sampled word run that :mod:`.repeats` deals contexts by, and
the whole window where that run is too frequent.  Each group's subtree is grown
level by level: the suffixes below a node are parted by their next word, and a
suffix that is alone in its branch is a leaf and is read no further, so that
unique text costs a few words and only what repeats is read to the full depth.
An internal node as deep as the window is a repeat; the suffixes below it are
its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import CHUNK_BYTES, HOT_ROWS, covered, repeated_windows
from .textarrays import text_column

#: consecutive equal words that count as a repeat
WINDOW_WORDS = 13
#: words hashed as an anchor; a window has 13 - 5 + 1 of them
GRAM_WORDS = 5


def grow(symbols: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, node) of the suffixes below internal nodes at ``depth`` of the tree of ``starts``.

    Suffix ``i`` is the run of symbols from ``starts[i]``; at least ``depth``
    follow.  Nodes are numbered; a node here has two suffixes or more.
    """
    live = np.arange(len(starts))
    node = np.zeros(len(starts), dtype=np.int64)
    kinds = int(symbols.max()) + 1 if len(symbols) else 1
    for d in range(depth):
        if not len(live):
            break
        branch = node * kinds + symbols[starts[live] + d]
        order = np.argsort(branch, kind="stable")
        branch, live = branch[order], live[order]
        new = np.append(True, branch[1:] != branch[:-1])
        inner = np.append(~new[1:], False) | ~new
        node = np.cumsum(new)[inner]
        node = np.cumsum(np.append(True, node[1:] != node[:-1])) if len(node) else node
        live = live[inner]
    return live, node


def shared_windows(contexts: list[bytes], counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window, class) of the word windows that occur more than once in a group of contexts."""
    if not contexts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    words = [c.split() for c in contexts]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    known: dict[bytes, int] = {}
    number = known.setdefault
    symbols = np.fromiter((number(w, len(known)) for ws in words for w in ws), dtype=np.int64, count=int(size.sum()))
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(contexts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    live, node = grow(symbols, begin[owner] + nth, window)
    return owner[live], nth[live], node


def repeated_words(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, id_col: str = "doc_id",
                   text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """_id, null_id, text and ``runs`` of the ``window``-word sequences that also start in a document before."""
    def index(contexts, counts):
        return shared_windows(contexts, counts, window)

    return repeated_windows(docs, window, gram, True, index, id_col, text_col, chunk_bytes, hot_rows,
                            other_documents=True)


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, id_col: str = "doc_id",
                   text_col: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, and with ``keep_text`` the kept words.

    Every word covered by a ``window``-word sequence that also starts in a
    document of smaller id is removed; sequences are judged on the input.  Words
    are runs of bytes other than the six ASCII blanks.  Null texts have no
    words; shorter texts lose nothing; rows with equal id and text are one
    document, each row with its result; null ids come first in order; texts
    under one id, or under null, lose nothing to each other; an empty
    table gives no rows.
    """
    found = repeated_words(docs, window, gram, id_col, text_col, **options)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "_id bigint, null_id boolean, n_words bigint, n_removed bigint, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = text_column(batch).cast(pa.large_binary())
            for text, runs in zip(texts, batch.column("runs")):
                words = text.as_py().split()
                gone = covered(runs, window, len(words))
                if gone.any():
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                else:
                    kept = b" ".join(words)
                rows.append((len(words), int(np.count_nonzero(gone)), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("null_id")] + [pa.array(c, type=pa.int64()) for c in cols[:2]]
                + [pa.array(cols[2], type=pa.string())] + ([pa.array(cols[3], type=pa.binary())] if keep_text else []),
                names=["_id", "null_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    out = found.select("_id", "null_id", "text", "runs").mapInArrow(run, schema + ", kept binary" * keep_text)
    return out.select(F.when(~F.col("null_id"), F.col("_id")).cast(kind).alias(id_col), "n_words", "n_removed",
                      "kept_sha256", *["kept"] * keep_text)
