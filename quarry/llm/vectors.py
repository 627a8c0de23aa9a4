"""What both vector searches share: valid distinct vectors in blocks, queries sent to every block, answers merged.

Equal vectors are indexed once, with the smallest ids among them: a vector in a
third of all rows costs one index row, and its ids beyond those that an answer
can hold never travel.  Distinct vectors are dealt into blocks of a few
thousand by a hash; every distinct query visits every block (a stated query set
against all rows, in blocks) and a block's task holds that block's index and one Arrow batch of
queries at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: an index over rows (n x d matrix, number of blocks) answers: (query rows) -> (query, row, score) arrays
Index = Callable[[np.ndarray, int], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]]


def usable(vec_col: str, nonzero: bool) -> Column:
    """Whether a vector has one finite number or more and nothing else, not all zero if ``nonzero``; never null."""
    ok = f"size(`{vec_col}`) > 0 AND forall(`{vec_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    ok += f" AND exists(`{vec_col}`, x -> x <> 0)" if nonzero else ""
    return F.coalesce(F.expr(ok), F.lit(False))


def valid(rows: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, v) with a non-null id and a vector of one finite double or more, not all zero if ``nonzero``."""
    df = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return df.where("id IS NOT NULL").where(usable("v", nonzero))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): every different vector with its ``keep`` smallest ids, reduced inside each batch first.

    Repeated rows (equal id and vector) count once.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list] = {}
            ids = batch.column("id").to_pylist()
            vs = batch.column("v")
            for i, v in zip(ids, vs):
                groups.setdefault(v.values.to_numpy().tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.frombuffer(b) for b in groups], type=pa.list_(pa.float64())),
                 pa.array([sorted(set(x))[:keep] for x in groups.values()], type=pa.list_(pa.int64()))],
                names=["v", "ids"])

    return (rows.select("id", "v").mapInArrow(local, "v array<double>, ids array<bigint>").groupBy("v")
            .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _answer(build: Index, blocks: int):
    """Reads rows sorted by (block, role): a block's vectors, then its queries, which are answered as they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, ids, ask = None, [], [], None
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            role = batch.column("role").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(block)).tolist()):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                m = _matrix(part.column("v"))
                if block[a] != at:
                    at, rows, ids, ask = block[a], [], [], None
                if role[a] == 0:
                    rows.append(m)
                    ids.append(part.column("key").to_numpy(zero_copy_only=False))
                    continue
                if not rows:
                    continue
                if ask is None:
                    ask, keys = build(np.concatenate(rows), blocks), np.concatenate(ids)
                query, row, score = ask(m)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(query)), pa.array(keys[row]), pa.array(score)],
                    names=["qkey", "key", "score"])
    return run


def search(rows: DataFrame, build: Index, k: int, query_step: int, block_rows: int, score_type: str,
           id_col: str = "vec_id", vec_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best of every row whose id ``query_step`` divides, ties to smaller ids.

    ``build`` makes a block's index; its answers hold each query's ``k + 1``
    best distinct vectors of the block (one may be the query's own).  Only
    vectors of equal length are compared.
    """
    good = valid(rows, id_col, vec_col, nonzero)
    index = cut_lineage(distinct_vectors(good, k + 1).select(F.xxhash64("v").alias("key"), "v", "ids"))
    count = index.count()
    blocks = max(1, -(-count // block_rows))
    asked = good.where(F.col("id") % query_step == 0).select("id", "v").distinct()
    queries = asked.select("v").distinct().select(F.xxhash64("v").alias("key"), "v")
    deal = F.concat_ws(":", F.size("v"), F.col("b"))
    here = index.select("key", "v", F.pmod("key", F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("role"))
    there = queries.select("key", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("role"))
    dealt = here.unionAll(there).select("key", "v", "role", deal.alias("block"))
    found = (dealt.repartition("block").sortWithinPartitions("block", "role", "key")
             .mapInArrow(_answer(build, blocks), f"qkey bigint, key bigint, score {score_type}"))
    best = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "first")
    # k + 1 vectors hold k answers whichever is the query's own; equal scores order by their smallest id
    near = (found.join(index.select("key", "ids", F.col("ids")[0].alias("first")), "key")
            .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1))
    each = (asked.select("id", F.xxhash64("v").alias("qkey")).join(near, "qkey")
            .select(F.col("id").alias("query_id"), "score", F.explode("ids").alias(id_col))
            .where(F.col("query_id") != F.col(id_col)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return (each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", id_col, "score"))


def best_rows(score: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best scores with their rows, and all that tie with the last."""
    if len(score) <= k:
        return rows, score
    least = np.partition(score, len(score) - k)[len(score) - k]
    pick = score >= least
    return rows[pick], score[pick]
