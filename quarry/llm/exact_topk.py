"""Exact top-k search by integer inner product with multi-resolution segment statistics.

A vector is cut into segments, coarse (one), middle and fine.  From the means m
and deviations s of the segments of width w, the squared distance of two
vectors is at least the sum of w ((m - m')^2 + (s - s')^2); with the norms
known, that is to say their inner product is at most the sum of
w (m m' + s s').  From coarse to fine, rows whose bound is below the k-th best
exact score so far are dropped; survivors get their exact score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole, whole_products
from .vectors import best_rows, search

SCALE = 1024
BLOCK_ROWS = 8192
NEIGHBOURS = 10
QUERY_STEP = 100
#: segments a vector is cut into, from coarse to fine
RESOLUTIONS = (1, 4, 16)


def segment_statistics(rows: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(width of each segment, means, deviations)."""
    dim = rows.shape[1]
    edges = np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(np.int64))
    width = np.diff(edges)
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.add.reduceat(rows, edges[:-1], axis=1) / width
        rest = rows - np.repeat(mean, width, axis=1)
        return width, mean, np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1) / width)


class SegmentIndex:
    """Statistics of the integer vectors of one block at every resolution."""

    def __init__(self, rows: np.ndarray, k: int, resolutions: tuple = RESOLUTIONS):
        self.rows, self.k, self.resolutions = whole(rows, SCALE), k, resolutions
        self.levels = [segment_statistics(self.rows, s) for s in resolutions]
        with np.errstate(over="ignore"):
            self.norm = np.sqrt(np.einsum("ij,ij->i", self.rows, self.rows))

    def _exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return whole_products(self.rows[rows], query)

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        queries = whole(queries, SCALE)
        stats = [segment_statistics(queries, s) for s in self.resolutions]
        with np.errstate(over="ignore"):
            norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        out = []
        for q in range(len(queries)):
            with np.errstate(over="ignore", invalid="ignore"):
                slack = 1e-9 * (norm[q] * self.norm + 1)       # above the rounding of the bounds
            live = np.arange(len(self.rows))
            least = None
            for (width, mean, dev), (_, qm, qs) in zip(self.levels, stats):
                with np.errstate(over="ignore", invalid="ignore"):
                    bound = mean[live] @ (width * qm[q]) + dev[live] @ (width * qs[q]) + slack[live]
                bound = np.where(np.isfinite(bound), bound, np.inf)     # a bound beyond the doubles says nothing
                if least is None and len(live) > self.k:
                    # the most promising rows give the first k-th best score
                    some = live[np.argpartition(-bound, self.k)[:4 * self.k]]
                    exact = self._exact(some, queries[q])
                    least = np.partition(exact, len(exact) - self.k - 1)[len(exact) - self.k - 1] \
                        if len(exact) > self.k else None
                if least is not None:
                    live = live[bound >= least]
            rows, score = best_rows(self._exact(live, queries[q]), live, self.k + 1)
            out.append((np.full(len(rows), q), rows, score))
        return tuple(np.concatenate(x) for x in zip(*out))


def top_k(rows: DataFrame, k: int = NEIGHBOURS, query_step: int = QUERY_STEP, block_rows: int = BLOCK_ROWS,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the highest integer inner products, for every row whose id ``query_step`` divides.

    A component x counts as floor(1024 x); a score that leaves 64 bits counts as
    the largest (or least) long.  Ties go to the smaller id; fewer rows than
    ``k`` give all.  Null ids, and vectors null, empty or with null or non-finite components, take no
    part; repeated rows count once; an empty table gives no rows.
    """
    return search(rows, lambda m, blocks: SegmentIndex(m, k), k, query_step, block_rows, "bigint", id_col, vec_col)
