"""Approximate nearest neighbours with a hash-prefix forest.

Each tree hashes every vector to a long string: two cross-polytope symbols (the
axis, of a random rotation, that the vector is nearest to) and a tail of
hyperplane signs.  A tree is the sorted array of its strings, so that all
vectors sharing a prefix with a query are one range, found by binary search.
A query descends to its longest prefix in every tree and ascends in all trees
together, to shorter prefixes, scoring exactly every vector it meets for the
first time.  It stops when a neighbour as near as the one it needs would have been met in
some tree with probability ``certainty``: tight clusters end at long prefixes,
vectors without near neighbours climb to short ones or to the root.

Forests stand on blocks of distinct vectors (see :mod:`.vectors`).  A vector in
the top k overall is, in a random block, as near as the block's
``ceil(k / blocks)``-th; that one's similarity sets the stop.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vectors import best_rows, search

TREES = 48
CERTAINTY = 0.93
TAIL_BITS = 16
BLOCK_ROWS = 8192
NEIGHBOURS = 5
QUERY_STEP = 50
_GRID = np.linspace(0.0, 1.0, 41)


def meeting_probability(dim: int, seed: int = 3) -> np.ndarray:
    """Chance that two vectors share a cross-polytope symbol, for cosines of the grid 0, 0.025, ..., 1.

    By rotation invariance a pair at cosine c is (a, c a + sqrt(1 - c^2) b) for independent
    Gaussian a and b, so the chance is simulated without any data.
    """
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, 4000, dim))
    rows = np.arange(len(a))
    ia = np.abs(a).argmax(axis=1)
    sa = a[rows, ia] > 0
    out = []
    for c in _GRID:
        y = c * a + np.sqrt(1 - c * c) * b
        iy = np.abs(y).argmax(axis=1)
        out.append(np.mean((iy == ia) & ((y[rows, iy] > 0) == sa)))
    return np.maximum.accumulate(np.array(out))


class Forest:
    """Sorted hash strings of the rows of one block."""

    def __init__(self, rows: np.ndarray, blocks: int, k: int, trees: int, certainty: float, seed: int = 23):
        self.k, self.trees, self.certainty = k, trees, certainty
        self.need = min(k + 1, -(-k // blocks) + 1)      # one more: the query's own vector may be in the block
        self.norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        self.rows = rows
        dim = rows.shape[1]
        rng = np.random.default_rng(seed)
        self.turn = [rng.standard_normal((dim, 2 * dim + TAIL_BITS)).astype(np.float32) for _ in range(trees)]
        self.symbol_bits = max(1, (2 * dim - 1).bit_length())
        p = meeting_probability(dim)
        sign = 1 - np.arccos(_GRID) / np.pi
        # prefix lengths from long to short, in bits, and the chance to share each
        tail, s = TAIL_BITS, self.symbol_bits
        self.lengths = [2 * s + tail, 2 * s + tail // 2, 2 * s, s]
        self.chance = [p * p * sign ** tail, p * p * sign ** (tail // 2), p * p, p]
        unit = (rows / self.norm[:, None]).astype(np.float32)
        codes = [self._codes(unit, t) for t in range(trees)]
        self.order = [np.argsort(c, kind="stable") for c in codes]
        self.sorted = [c[o] for c, o in zip(codes, self.order)]

    def _codes(self, unit: np.ndarray, tree: int) -> np.ndarray:
        dim = unit.shape[1]
        y = unit @ self.turn[tree]
        code = np.zeros(len(unit), dtype=np.uint64)
        at = np.arange(len(unit))
        for half in (y[:, :dim], y[:, dim:2 * dim]):
            axis = np.abs(half).argmax(axis=1)
            symbol = 2 * axis + (half[at, axis] > 0)
            code = code << np.uint64(self.symbol_bits) | symbol.astype(np.uint64)
        signs = np.packbits(y[:, 2 * dim:] > 0, axis=1).view(">u2").ravel()
        return code << np.uint64(TAIL_BITS) | signs.astype(np.uint64)

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        unit = (queries / norm[:, None]).astype(np.float32)
        full = self.lengths[0]
        lo = np.empty((len(self.lengths), self.trees, len(queries)), dtype=np.int64)
        hi = np.empty_like(lo)
        for t in range(self.trees):
            code = self._codes(unit, t)
            for i, length in enumerate(self.lengths):
                cut = np.uint64(full - length)
                low = code >> cut << cut
                lo[i, t] = np.searchsorted(self.sorted[t], low)
                hi[i, t] = np.searchsorted(self.sorted[t], low + (np.uint64(1) << cut))
        out = []
        for q in range(len(queries)):
            met = np.zeros(len(self.rows), dtype=bool)
            rows, score = np.zeros(0, dtype=np.int64), np.zeros(0)
            for i in range(len(self.lengths) + 1):
                now = met.copy()
                if i == len(self.lengths):
                    now[:] = True
                else:
                    for t in range(self.trees):
                        now[self.order[t][lo[i, t, q]:hi[i, t, q]]] = True
                new = np.flatnonzero(now & ~met)
                met = now
                if len(new):
                    rows = np.append(rows, new)
                    score = np.append(score, (self.rows[new] @ queries[q]) / (self.norm[new] * norm[q]))
                if i < len(self.lengths) and len(score) >= self.need:
                    near = np.partition(score, len(score) - self.need)[len(score) - self.need]
                    share = np.interp(near, _GRID, self.chance[i])
                    if near > 0 and (1 - share) ** self.trees <= 1 - self.certainty:
                        break
            best, s = best_rows(score, rows, self.k + 1)
            out.append((np.full(len(best), q), best, s))
        return tuple(np.concatenate(x) for x in zip(*out))


def nearest(rows: DataFrame, k: int = NEIGHBOURS, query_step: int = QUERY_STEP, trees: int = TREES,
            certainty: float = CERTAINTY, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the nearest found by cosine, for every row whose id ``query_step`` divides.

    Scores are exact cosines of the original vectors in double precision; ties
    go to the smaller id; fewer rows than ``k`` give all.  Null ids, and
    vectors null, zero or with null or non-finite components, take no part;
    repeated rows count once; an empty table gives no rows.
    """
    return search(rows, lambda m, blocks: Forest(m, blocks, k, trees, certainty), k, query_step, block_rows, "double",
                  id_col, vec_col, nonzero=True)
