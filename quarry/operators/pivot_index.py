"""Exact nearest rows by Euclidean distance: cells around pivots, visited by triangle-inequality bounds.

*Index.* Equal points are one row with their first ``keep`` members in tie
order.  A bounded sample of points are the pivots; every point lies in the cell
of its nearest pivot, and a cell is cut into parts of ``cell_rows`` points, each
with the least and the greatest distance of its points to the pivot.

*Search.* Equal queries are one query.  It first visits the parts of its
nearest cells until these hold k points, which gives an upper bound of its
k-th distance; then every part that the triangle inequality, and the
plane halfway between two pivots, leave within that bound.  Inside a part only
points in the ring of that width around the query's own distance to the pivot
are looked at.  A first visit is a row for each part; then stripes of many parts
are visited, a row for each stripe, so that a query whose bounds prune little
travels, and answers, once for thousands of points.  A task holds one stripe and
one Arrow batch of queries, goes from part to part with all queries that reach
it (one matrix product, exact distances for what that leaves), and narrows each
query's bound on the way.  No bound decides a result: what is left out is
farther away than the k-th.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: most pivots, and most numbers that they may hold together
MAX_PIVOTS, PIVOT_FLOATS = 2048, 1 << 22
#: points of one part of a cell, and numbers that they may hold together
CELL_ROWS, CELL_FLOATS = 4096, 1 << 22
#: numbers that the points of a stripe may hold together, and stripes for each core below that
STRIPE_FLOATS, CORE_STRIPES = 1 << 22, 4
#: queries that are compared with a part together
QUERY_ROWS = 1024
_NEAR = "near array<struct<d: double, tie: bigint, y: double>>"


def point_key(x: str) -> Column:
    """128 bits of hash of a point."""
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))


def matrix(column: pa.Array) -> np.ndarray:
    """Points of equal length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, up to rounding."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    return np.maximum(na[:, None] + nb - 2 * a @ b.T, 0)


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """More than the rounding of :func:`squared` and of sums of as many terms, for each row of ``a`` against all of ``b``."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    return 1e-12 * (1 + a.shape[1]) * (na + (nb.max() if len(nb) else 0.0))


def exact_distance(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances by their definition, summed in the order of the components, to one query or (components x rows) each row's own."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += np.square(rows[:, j] - query[j])
    return np.sqrt(out)


class Cells:
    """Pivots and the parts of their cells: what a query's route depends on."""

    def __init__(self, pivots: np.ndarray, parts: np.ndarray):
        """``parts`` has a row (pivot, points, least distance, greatest distance) for each part, sorted by pivot."""
        self.pivots, self.parts = pivots, parts
        self.pivot = parts[:, 0].astype(np.int64) if len(parts) else np.zeros(0, dtype=np.int64)
        apart = np.sqrt(squared(pivots, pivots)) if len(pivots) else np.zeros((0, 0))
        self.apart = apart

    def routes(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(home parts, distances to the pivots, slack) of each query: parts of the nearest cells until they hold ``k`` points."""
        for a in range(0, len(queries), 1024):
            q = queries[a:a + 1024]
            sq = squared(q, self.pivots)
            room = np.sqrt(slack(q, self.pivots))
            for d2, s in zip(sq, room):
                d = np.sqrt(d2)
                near = np.argsort(d[self.pivot], kind="stable")
                held = np.cumsum(self.parts[near, 1])
                last = int(np.searchsorted(held, k))
                if last >= len(near):
                    yield near, d, s
                    continue
                # all parts of the last cell
                yield np.flatnonzero(d[self.pivot] <= d[self.pivot[near[last]]]), d, s

    def within(self, d: np.ndarray, s: float, limit: float) -> np.ndarray:
        """The parts that can hold a point within ``limit`` of a query whose distances to the pivots are ``d``."""
        p = self.pivot
        wide = limit + 2 * s
        ok = (d[p] - self.parts[:, 3] <= wide) & (self.parts[:, 2] - d[p] <= wide)
        # the query's distance to the plane between its own cell and another
        home = int(np.argmin(d))
        gap = self.apart[home]
        beyond = np.divide(d * d - d[home] ** 2, 2 * gap, out=np.zeros_like(d), where=gap > 0)
        return np.flatnonzero(ok & (beyond[p] <= wide))


    def reach(self, queries: np.ndarray, limit: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """:meth:`within` for many queries: whether each may find a point in each of ``parts``."""
        d, s = np.sqrt(squared(queries, self.pivots)), np.sqrt(slack(queries, self.pivots))
        wide = (limit + 2 * s)[:, None]
        p, at = self.pivot[parts], np.arange(len(d))
        home = np.argmin(d, axis=1)
        near = d[:, p]
        gap = 2 * self.apart[home][:, p]
        beyond = np.divide(near * near - np.square(d[at, home])[:, None], gap, out=np.zeros_like(near), where=gap > 0)
        return (near - self.parts[parts, 3] <= wide) & (self.parts[parts, 2] - near <= wide) & (beyond <= wide)


def _place(pivots: np.ndarray):
    """The nearest pivot of each point and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            pivot = np.concatenate([np.argmin(squared(x[a:a + 1024], pivots), axis=1) for a in range(0, len(x), 1024)]
                                   or [np.zeros(0, dtype=np.int64)])
            far = np.sqrt(np.square(x - pivots[pivot]).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "pivot", "far"])
    return run


class Part:
    """The points of one part, by their distance to the pivot."""

    def __init__(self, batches: list[pa.RecordBatch], pivot: np.ndarray):
        t = pa.Table.from_batches(batches).combine_chunks()
        far = t.column("far").to_numpy()
        order = np.argsort(far, kind="stable")
        t = t.take(pa.array(order))
        self.far, self.pivot = far[order], pivot
        self.x = matrix(t.column("x").combine_chunks())
        members = t.column("members").combine_chunks()
        self.start = np.append(0, np.cumsum(members.value_lengths().to_numpy()))
        self.tie, self.y = (f.to_numpy(zero_copy_only=False) for f in members.flatten().flatten())
        # the product of (query, 1) and a lifted point is their squared distance less the query's square
        square = np.einsum("ij,ij->i", self.x, self.x)
        self.lifted, self.top = np.hstack([-2 * self.x, square[:, None]]), float(square.max(initial=0.0))

    def add(self, best: "Nearest", rows: np.ndarray) -> None:
        """What the part holds within the limits of the queries ``rows`` joins their nearest."""
        for a in range(0, len(rows), QUERY_ROWS):
            self._add(best, rows[a:a + QUERY_ROWS])

    def _add(self, best: "Nearest", rows: np.ndarray) -> None:
        q, limit, k = best.x[rows], best.limit[rows], best.k
        d = np.sqrt(np.square(q - self.pivot).sum(axis=1))
        room = 1e-9 * (1 + d + limit + (self.far[-1] if len(self.far) else 0.0))
        # one ring for all queries
        a = int(np.searchsorted(self.far, (d - limit - room).min()))
        b = int(np.searchsorted(self.far, (d + limit + room).max(), side="right"))
        if a >= b:
            return
        square = np.einsum("ij,ij->i", q, q)
        margin = 1e-12 * (1 + q.shape[1]) * (square + self.top)
        rough = np.hstack([q, np.ones((len(q), 1))]) @ self.lifted[a:b].T
        bound = limit * limit
        wide = np.flatnonzero(~np.isfinite(limit))
        if len(wide) and b - a > k:
            bound[wide] = np.maximum(np.partition(rough[wide], k - 1, axis=1)[:, k - 1] + square[wide], 0) + margin[wide]
        of, pick = np.nonzero(rough <= (bound * (1 + 1e-12) + margin - square)[:, None])
        for c in range(0, len(of), 1 << 18):
            i, p = of[c:c + (1 << 18)], pick[c:c + (1 << 18)] + a
            d = exact_distance(self.x[p], q[i].T)
            near = d <= limit[i]
            i, p, d = i[near], p[near], d[near]
            many = self.start[p + 1] - self.start[p]
            at = np.repeat(self.start[p] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            best.take(rows[np.repeat(i, many)], np.repeat(d, many), self.tie[at], self.y[at])


class Nearest:
    """The ``k`` nearest (distance, tie, y) found for each of some queries, and the distance within which more may lie."""

    def __init__(self, x: np.ndarray, limit: np.ndarray, k: int):
        self.x, self.limit, self.k = x, limit.astype(float), k
        self.held = [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0)]
        self.waiting: list[list[np.ndarray]] = []
        self.count = 0

    def take(self, row: np.ndarray, d: np.ndarray, tie: np.ndarray, y: np.ndarray) -> None:
        """Some that lie within the limits; merged once they are as many as those that are kept."""
        self.waiting.append([row, d, tie, y])
        self.count += len(row)
        if self.count >= max(4096, self.k * len(self.x) // 2):
            self.merge()

    def merge(self) -> None:
        """Only the ``k`` nearest stay, ties in order; a full list narrows its query's limit."""
        row, d, tie, y = (np.concatenate(c) for c in zip(self.held, *self.waiting))
        self.waiting, self.count = [], 0
        order = np.lexsort((tie, d, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = np.flatnonzero(place == self.k - 1)
        self.limit[row[last]] = np.minimum(self.limit[row[last]], d[order[last]])
        first = place < self.k
        order = order[first]
        self.held = [row[first], d[order], tie[order], y[order]]

    def lists(self) -> pa.Array:
        """Each query's list in order."""
        self.merge()
        row, d, tie, y = self.held
        ends = np.searchsorted(row, np.arange(len(self.x) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
            [pa.array(d), pa.array(tie.astype(np.int64)), pa.array(y.astype(float))], names=["d", "tie", "y"]))


def _search(cells: Cells, k: int, last: bool):
    """Reads rows sorted by (stripe, role): the points of a stripe by their parts, then its visitors; gives what each found there.

    The ``last`` time the queries' points are no longer needed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            stripe = batch.column("stripe").to_numpy(zero_copy_only=False)
            role = batch.column("role").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((stripe[1:] != stripe[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(stripe)).tolist()):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if stripe[a] != at:
                    at, held, index = stripe[a], [], None
                if role[a] == 0:
                    held.append(some)
                    continue
                if index is None:
                    index = _parts(held, cells)
                    held = []
                best = Nearest(matrix(some.column("x")), some.column("limit").to_numpy(zero_copy_only=False), k)
                known = np.array(list(index), dtype=np.int64)
                known = known[np.argsort(cells.pivot[known], kind="stable")]
                visits = np.concatenate([cells.reach(best.x[i:i + QUERY_ROWS], best.limit[i:i + QUERY_ROWS], known)
                                         for i in range(0, len(best.x), QUERY_ROWS)])
                for part, who in zip(known.tolist(), visits.T):
                    if who.any():
                        index[part].add(best, np.flatnonzero(who))
                x = some.column("x")
                yield pa.RecordBatch.from_arrays([some.column("q"), pa.nulls(len(x), x.type) if last else x, best.lists()],
                                                 names=["q", "x", "near"])
    return run


def _parts(batches: list[pa.RecordBatch], cells: Cells) -> dict[int, Part]:
    """The points of a stripe by their part."""
    if not batches:
        return {}
    t = pa.Table.from_batches(batches).combine_chunks()
    part = t.column("part").to_numpy()
    order = np.argsort(part, kind="stable")
    t = t.take(pa.array(order)).combine_chunks()
    kinds, begin = np.unique(part[order], return_index=True)
    ends = np.append(begin, len(part))
    return {int(p): Part(t.slice(a, b - a).to_batches(), cells.pivots[cells.pivot[p]])
            for p, a, b in zip(kinds, ends[:-1].tolist(), ends[1:].tolist())}


def _route(cells: Cells, k: int, stripes: np.ndarray | None):
    """One row for each visit: first to the parts of the nearest cells, then (``stripes`` of all parts) to all stripes within the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(cells.parts))
        begin = None if stripes is None else np.flatnonzero(np.append(True, stripes[1:] != stripes[:-1]))
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("x"))
            limit = batch.column("limit").to_numpy(zero_copy_only=False)
            if stripes is None:
                homes = [home for home, _, _ in cells.routes(x, k)]
                who, to = np.repeat(np.arange(len(homes)), [len(h) for h in homes]), np.concatenate(homes)
            else:
                some = [np.logical_or.reduceat(cells.reach(x[a:a + QUERY_ROWS], limit[a:a + QUERY_ROWS], every), begin, axis=1)
                        for a in range(0, len(x), QUERY_ROWS)]
                who, to = np.nonzero(np.concatenate(some))
                to = stripes[begin][to]
            for a in range(0, len(who), 10_000):
                some = batch.select(["q", "x", "limit"]).take(pa.array(who[a:a + 10_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[a:a + 10_000].astype(np.int32)), pa.array(np.ones(len(some), dtype=np.int32)), *some.columns],
                    names=["stripe", "role", "q", "x", "limit"])
    return run


class PivotIndex:
    """The indexed points (part, x, members, far) and their :class:`Cells`."""

    def __init__(self, points: DataFrame, cells: Cells):
        self.points, self.cells = points, cells

    @staticmethod
    def build(rows: DataFrame, keep: int, max_pivots: int = MAX_PIVOTS, cell_rows: int = CELL_ROWS) -> "PivotIndex":
        """An index of rows (x array<double>, tie bigint, y double) for up to ``keep`` neighbours.

        The points of a table have one length.  Rows whose point has a null or
        non-finite number take no part.  Ties must be different numbers.
        """
        good = rows.where(F.expr("size(x) > 0 AND forall(x, v -> v IS NOT NULL AND abs(v) < double('infinity') AND NOT isnan(v))"))
        # the first members of each point are found before the shuffle; a point in a third of all rows keeps ``keep``
        order = Window.partitionBy("x").orderBy("tie")
        first = good.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
        points = cut_lineage(first.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("tie", "y"))).alias("members")))
        about = points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
        n, dim = about["n"], max(1, about["dim"] or 1)
        if not n:
            return PivotIndex(points.select(F.lit(0).alias("part"), "x", "members", F.lit(0.0).alias("far")),
                              Cells(np.zeros((0, dim)), np.zeros((0, 4))))
        count = max(1, min(max_pivots, PIVOT_FLOATS // dim, int(n ** 0.5)))
        sample = points.select("x").orderBy(F.xxhash64(F.lit(7), "x"), "x").limit(count).collect()
        pivots = np.array([r["x"] for r in sample], dtype=np.float64)
        placed = cut_lineage(points.mapInArrow(_place(pivots), "x array<double>, members array<struct<tie: bigint, y: double>>, "
                                               "pivot int, far double"))
        size = max(1, min(cell_rows, CELL_FLOATS // dim))
        sizes = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
        cuts = [-(-sizes.get(p, 0) // size) for p in range(len(pivots))]
        total = sum(cuts)
        begin = [sum(cuts[:p]) for p in range(len(pivots))]
        first_part, many = (F.array(*map(F.lit, v))[F.col("pivot")] for v in (begin, cuts))
        part = (first_part + F.pmod(F.xxhash64("x"), many)).cast("int")
        points = cut_lineage(placed.withColumn("part", part))
        seen = {r["part"]: r for r in points.groupBy("part").agg(
            F.first("pivot").alias("pivot"), F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect()}
        owner = [p for p, m in enumerate(cuts) for _ in range(m)]
        # the hash may leave a part empty
        parts = np.array([[owner[i], seen[i]["n"], seen[i]["lo"], seen[i]["hi"]] if i in seen else [owner[i], 0, np.inf, -np.inf]
                          for i in range(total)])
        return PivotIndex(points.select("part", "x", "members", "far"), Cells(pivots, parts))

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, near): of each different point ``x`` of the queries, by :func:`point_key`, its ``k`` nearest (d, tie, y) in order.

        Fewer rows than ``k`` give all; a point that is null, empty or not finite has no row.
        """
        asked = (queries.select("x").where(F.expr(
                    "size(x) > 0 AND forall(x, v -> v IS NOT NULL AND abs(v) < double('infinity') AND NOT isnan(v))"))
                 .select(point_key("x").alias("q"), "x").dropDuplicates(["q"]).withColumn("limit", F.lit(float("inf"))))
        if not len(self.cells.parts):
            return asked.select("q", F.expr(f"cast(NULL as {_NEAR.split(' ', 1)[1]})").alias("near")).where(F.lit(False))
        cores = self.points.sparkSession.sparkContext.defaultParallelism
        homes = self._visited(asked, k, None, min(len(self.cells.parts), CORE_STRIPES * cores))
        # a query that found fewer than k may find the others anywhere
        known = homes.select("q", "x", F.when(F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf"))).alias("limit"))
        stripes = self._stripes(CORE_STRIPES * cores)
        return self._visited(known, k, stripes, int(stripes.max()) + 1).select("q", "near")

    def _stripes(self, least: int) -> np.ndarray:
        """The stripe of each part: whole parts in their order, up to ``STRIPE_FLOATS`` numbers, or ``least`` stripes where there are as many parts."""
        points = self.cells.parts[:, 1]
        size = max(1.0, min(STRIPE_FLOATS / max(1, self.cells.pivots.shape[1]), points.sum() / least))
        return np.floor(np.maximum(np.cumsum(points) - points, 0) / size).astype(np.int64)

    def _visited(self, asked: DataFrame, k: int, stripes: np.ndarray | None, tasks: int) -> DataFrame:
        """(q, x, near) of the queries (q, x, limit) over the parts of their nearest cells, or over all ``stripes`` within the limit."""
        place = F.col("part") if stripes is None else F.array(*map(F.lit, stripes.tolist()))[F.col("part")]
        here = self.points.select(
            place.cast("int").alias("stripe"), F.lit(0).alias("role"), F.expr("cast(NULL as struct<a: bigint, b: bigint>)").alias("q"),
            "x", F.lit(None).cast("double").alias("limit"), "part", "members", "far")
        visits = asked.mapInArrow(_route(self.cells, k, stripes), "stripe int, role int, q struct<a: bigint, b: bigint>, x array<double>, limit double")
        visits = visits.select("*", F.lit(None).cast("int").alias("part"),
                               F.expr("cast(NULL as array<struct<tie: bigint, y: double>>)").alias("members"), F.lit(None).cast("double").alias("far"))
        seen = (here.unionAll(visits).repartitionById(tasks, F.pmod("stripe", F.lit(tasks))).sortWithinPartitions("stripe", "role")
                .mapInArrow(_search(self.cells, k, stripes is not None), f"q struct<a: bigint, b: bigint>, x array<double>, {_NEAR}"))
        return seen.groupBy("q").agg(F.first("x").alias("x"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
