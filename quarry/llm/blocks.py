"""Tasks over blocks of rows: what a block holds comes first, then what is asked of it, in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa


class Block(Protocol):
    """What one block's task keeps."""

    def hold(self, part: pa.RecordBatch) -> None:
        """Take in rows of the block (role 0)."""

    def ask(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Answer queries (role 1), which come after all rows."""

    def end(self) -> Iterator[pa.RecordBatch]:
        """What is known only after the last query."""


def visit(make: Callable[[], Block]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function over rows sorted by (block, role); one block is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here = None, None
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            role = batch.column("role").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(block)).tolist()):
                if a == b:
                    continue
                if here is None or block[a] != at:
                    if here is not None:
                        yield from here.end()
                    at, here = block[a], make()
                part = batch.slice(a, b - a)
                if role[a] == 0:
                    here.hold(part)
                else:
                    yield from here.ask(part)
        if here is not None:
            yield from here.end()
    return run


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def whole(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, in doubles; what leaves the doubles counts as their largest."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * rows))


def whole_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; only products that leave 64 bits count as the largest long."""
    most, dim = float(np.abs(query).max(initial=0.0)), max(1, len(query))
    size = np.abs(rows).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        bound = size * most * dim
    top = float(bound.max(initial=0.0))
    if top < 2.0 ** 53:
        return (rows @ query).astype(np.int64)      # every partial sum is a whole double
    out = np.empty(len(rows), dtype=np.int64)
    small = (bound < 2.0 ** 62) & (size < 2.0 ** 62)
    if most < 2.0 ** 62:
        out[small] = rows[small].astype(np.int64) @ query.astype(np.int64)
    else:
        small[:] = False
    ints = [int(x) for x in query.tolist()] if not small.all() else []
    for i in np.flatnonzero(~small).tolist():
        s = sum(int(x) * y for x, y in zip(rows[i].tolist(), ints))
        out[i] = max(-(1 << 63), min((1 << 63) - 1, s))
    return out
