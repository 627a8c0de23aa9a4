"""Training rows in blocks, and vectors summed over them on the executors.

Feature vectors stay as they are stored: rows of sparse vectors (tf-idf words)
become compressed rows, rows of dense vectors a matrix.  A block holds a
bounded count of numbers, so that neither packing nor an evaluation expands a
sparse row to the width of its vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENSE_VALUES = 1 << 20          # numbers in a block of dense rows
SPARSE_VALUES = 1 << 16         # stored numbers in a block of sparse rows
CACHED_ROWS = 2048              # dense rows that are passed over together
CHUNK = 8192                    # numbers of a summed vector that travel together
DRIVER_VALUES = 1 << 20         # numbers of partial sums up to which they are added on the driver, not in an exchange
TASK_BLOCKS = 4                 # full sparse blocks that one task passes over; dense ones count by their share of one

_SCHEMA = "p int, d int, ptr binary, idx binary, val binary, y binary, w binary"


def stored(features: str) -> list[Column]:
    """size, indices and values of a vector column as it is stored; indices are null in a dense vector."""
    v = F.unwrap_udt(F.col(features))
    return [F.coalesce(v["size"], F.size(v["values"])).alias("size"), v["indices"].alias("indices"),
            v["values"].alias("values")]


class Rows:
    """A block of feature rows: dense (``ptr`` is None, ``val`` a matrix) or compressed sparse rows."""

    def __init__(self, d: int, ptr: np.ndarray | None, idx: np.ndarray | None, val: np.ndarray):
        self.d, self.ptr, self.idx = d, ptr, idx
        self.val = val.reshape(-1, d) if ptr is None and d else val
        self.n = len(self.val) if ptr is None else len(ptr) - 1

    @classmethod
    def of(cls, size, indices, values) -> Rows:
        """From pandas columns as :func:`stored` gives them; dense only if every row is."""
        d = int(size.iloc[0])
        if indices.isna().all():
            return cls(d, None, None, np.stack(values.to_numpy()).astype(float))
        idx = [np.arange(d) if i is None else i for i in indices]
        ptr = np.concatenate(([0], np.cumsum([len(i) for i in idx])))
        return cls(d, ptr, np.concatenate(idx).astype(np.int64), np.concatenate(values.to_numpy()).astype(float))

    def slices(self) -> Iterator[tuple[slice, Rows]]:
        """Dense rows a few at a time, so that what is computed of them stays in a core's cache; sparse ones whole."""
        if self.ptr is not None:
            yield slice(None), self
            return
        for a in range(0, self.n, CACHED_ROWS):
            at = slice(a, a + CACHED_ROWS)
            yield at, Rows(self.d, None, None, self.val[at])

    def __matmul__(self, W: np.ndarray) -> np.ndarray:
        """Rows times the matrix ``W``."""
        if self.ptr is None:
            return self.val @ W
        out = np.zeros((self.n, W.shape[1]))
        full = np.flatnonzero(np.diff(self.ptr))
        if len(full):
            out[full] = np.add.reduceat(self.val[:, None] * W[self.idx], self.ptr[full], axis=0)
        return out

    def back(self, R: np.ndarray) -> np.ndarray:
        """The transposed rows times the matrix ``R`` (one row of it for each of theirs)."""
        if self.ptr is None:
            return self.val.T @ R
        out = np.zeros((self.d, R.shape[1]))
        if len(self.idx):
            order = np.argsort(self.idx, kind="stable")
            column = self.idx[order]
            heads = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            row = np.repeat(np.arange(self.n), np.diff(self.ptr))[order]
            out[column[heads]] = np.add.reduceat(self.val[order, None] * R[row], heads, axis=0)
        return out


def training_blocks(df: DataFrame, features: str, label: str, weight: Column) -> DataFrame:
    """Blocks of rows as bytes, with labels and weights; rows without a label take no part."""
    rows = df.select(*stored(features), F.col(label).cast("double").alias("y"), weight.cast("double").alias("w")) \
        .where(F.col("y").isNotNull())

    def pack(batches):
        import pandas as pd
        for b in batches:
            if not len(b):
                continue
            dense = b["indices"].isna().all()
            held = np.cumsum([len(v) for v in b["values"]]) // (DENSE_VALUES if dense else SPARSE_VALUES)
            for _, part in b.groupby(held, sort=True):
                x = Rows.of(part["size"], part["indices"], part["values"])
                yield pd.DataFrame({
                    "p": [TaskContext.get().partitionId()], "d": [x.d], "ptr": [None if x.ptr is None else x.ptr.astype(np.int64).tobytes()],
                    "idx": [None if x.ptr is None else x.idx.tobytes()], "val": [x.val.tobytes()],
                    "y": [part["y"].to_numpy(float).tobytes()], "w": [part["w"].to_numpy(float).tobytes()]})

    return rows.mapInPandas(pack, _SCHEMA)


def measured(blocks: DataFrame) -> tuple[int | None, int]:
    """The number of features (None without blocks) and how many tasks a pass over the blocks is worth.

    A pass over few numbers costs little but its tasks: they follow the numbers
    that the blocks hold, not the number of partitions that the rows came in.
    """
    numbers = F.octet_length("val") / 8
    full = numbers / F.when(F.col("ptr").isNull(), F.lit(DENSE_VALUES)).otherwise(F.lit(TASK_BLOCKS * SPARSE_VALUES))
    r = blocks.agg(F.max("d").alias("d"), F.ceil(F.sum(full)).alias("tasks")).first()
    return r["d"], max(1, r["tasks"] or 1)


def sum_over(blocks: DataFrame, theta: np.ndarray, fn, tasks: int | None = None) -> tuple[float, np.ndarray, float]:
    """Sums of ``fn(theta, rows, y, w) -> (loss, gradient)`` and of the weights over all blocks.

    The blocks of each partition that was packed are added up, in up to
    ``tasks`` tasks; the vectors meet in chunks, added in the order of those
    partitions, so that a rerun gives the same bits.  Few and short ones, up to
    ``DRIVER_VALUES`` numbers in all, meet on the driver: a pass is then one stage.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(theta)
    size = len(theta)

    def part(batches):
        import pandas as pd
        f, g, n, at = 0.0, np.zeros(size), 0.0, None

        def vectors():
            cuts = range(0, size, CHUNK)
            return pd.DataFrame({"k": [-1, *range(len(cuts))], "p": at,
                                 "v": [np.array([f, n]).tobytes(), *[g[c:c + CHUNK].tobytes() for c in cuts]]})

        for b in batches:
            for p, d, ptr, idx, val, y, w in b.itertuples(index=False):
                if p != at:
                    if n:
                        yield vectors()
                    f, g, n, at = 0.0, np.zeros(size), 0.0, p
                weights = np.frombuffer(w)
                sparse = ptr is not None
                x = Rows(d, np.frombuffer(ptr, dtype=np.int64) if sparse else None,
                         np.frombuffer(idx, dtype=np.int64) if sparse else None, np.frombuffer(val))
                bf, bg = fn(shared.value, x, np.frombuffer(y), weights)
                f, n = f + bf, n + weights.sum()
                g += bg
        if n:
            yield vectors()

    def added(pdf):
        total = 0.0
        for v in pdf.sort_values("p")["v"]:
            total = total + np.frombuffer(v)
        return total

    def add(pdf):
        import pandas as pd
        return pd.DataFrame({"k": pdf["k"].iloc[:1].to_numpy(), "v": [added(pdf).tobytes()]})

    few = blocks.rdd.getNumPartitions() * (size + 2) <= DRIVER_VALUES
    sums = (blocks.coalesce(tasks) if tasks else blocks).mapInPandas(part, "k int, p int, v binary")
    rows = (sums if few else sums.groupBy("k").applyInPandas(add, "k int, v binary")).toPandas()
    shared.unpersist()
    if rows.empty:
        return 0.0, np.zeros(size), 0.0
    (f, n), *g = [added(part) if few else np.frombuffer(part["v"].iat[0]) for _, part in rows.groupby("k", sort=True)]
    return float(f), np.concatenate(g), float(n)


def scored(features: str, fn) -> Column:
    """array<double> column: ``fn(rows)`` gives one row of numbers for each row of features."""
    @F.pandas_udf("array<double>")
    def score(size, indices, values):
        import pandas as pd
        return pd.Series(list(fn(Rows.of(size, indices, values))) if len(size) else [], dtype=object)

    return score(*stored(features))
