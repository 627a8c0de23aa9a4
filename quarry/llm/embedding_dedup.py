"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Distinct vectors, scaled to length one, are dealt into inverted lists by their
nearest coarse centroid.  What is left after the centroid is coded in
``subspaces`` codewords, and the length of what the code misses is kept with
it.  A vector visits its own list and every list whose border it is near; there
the table of its products with all codewords gives its distance to each coded
vector by look-ups alone.  The triangle inequality with the kept length says
which vectors may lie within the threshold (none that does is lost), and those
get their exact cosine.

*Probes.* Two vectors at cosine ``t`` are at most ``w = sqrt(2 - 2 t)`` apart; a
step of that length in a random direction of d dimensions moves a vector
towards a list's border by ``w / sqrt(d)`` in the mean square.  A vector probes each
list whose border is nearer than ``reach`` times that.  A link counts for both
ends when one of them finds it.

*Hot groups.* Equal vectors are one row with a count.  Lists are dealt into
shards of ``shard_rows``; a longer list becomes several.  Links are not listed:
a shard reports, for each vector, how many it is linked to there, and a
spanning set of the links, both no longer than the rows it read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import matrix, visit
from .components import components, local_roots
from .vectors import usable

THRESHOLD = 0.9
SUBSPACES, CODEWORDS = 8, 256
#: vectors to a coarse list, and most lists; beyond, lists grow and are split into shards
LIST_ROWS, MAX_LISTS = 256, 4096
#: sample that centroids and codewords are fitted on: so many vectors for each list, so many at least
LIST_SAMPLE, LEAST_SAMPLE = 16, 4096
SHARD_ROWS = 8192
REACH = 3.0
_QUERIES = 512


def kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """``k`` centroids of the rows, or all different rows where they are fewer."""
    some = np.unique(rows, axis=0)
    if len(some) <= k:
        return some
    c = some[np.sort(rng.choice(len(some), k, replace=False))]
    for _ in range(rounds):
        at = nearest(rows, c)
        many = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(many)
        begin = (np.cumsum(many) - many)[full]
        c = c.copy()
        c[full] = np.add.reduceat(rows[order], begin, axis=0) / many[full, None]
    return c


def nearest(rows: np.ndarray, centroids: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Index of each row's nearest centroid."""
    half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)
    return np.concatenate([np.argmin(half - rows[a:a + chunk] @ centroids.T, axis=1)
                           for a in range(0, len(rows), chunk)] or [np.zeros(0, dtype=np.int64)])


def neighbourly(centroids: np.ndarray) -> np.ndarray:
    """An order in which near centroids stand together: halves along the widest direction, again and again."""
    def walk(part: np.ndarray) -> list[int]:
        if len(part) < 3:
            return part.tolist()
        x = centroids[part] - centroids[part].mean(axis=0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        part = part[np.argsort(along, kind="stable")]
        return walk(part[:len(part) // 2]) + walk(part[len(part) // 2:])
    return np.array(walk(np.arange(len(centroids))), dtype=np.int64)


@dataclass
class Quantiser:
    """Coarse centroids and residual codebooks of unit vectors of one length."""

    centroids: np.ndarray       # lists x d
    books: list                 # codewords x width, one for each subspace
    edges: np.ndarray           # bounds of the subspaces

    @staticmethod
    def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS,
            seed: int = 31) -> "Quantiser":
        rng = np.random.default_rng(seed)
        unit = sample / np.linalg.norm(sample, axis=1)[:, None]
        c = kmeans(unit, lists, rng)
        c = c[neighbourly(c)]
        rest = unit - c[nearest(unit, c)]
        edges = np.linspace(0, unit.shape[1], min(subspaces, unit.shape[1]) + 1).astype(np.int64)
        books = [kmeans(rest[:, a:b], codewords, rng) for a, b in zip(edges[:-1], edges[1:])]
        return Quantiser(c, books, edges)

    def code(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codeword of each subspace, length of what the code misses) of vectors of the given lists."""
        rest = unit - self.centroids[home]
        codes = np.stack([nearest(rest[:, a:b], k) for k, a, b in zip(self.books, self.edges[:-1], self.edges[1:])], axis=1)
        miss = sum(np.square(rest[:, a:b] - k[c]).sum(axis=1)
                   for k, c, a, b in zip(self.books, codes.T, self.edges[:-1], self.edges[1:]))
        return codes.astype(np.uint8), np.sqrt(miss)

    def border(self) -> np.ndarray:
        """Distances between centroids."""
        sq = np.einsum("ij,ij->i", self.centroids, self.centroids)
        return np.sqrt(np.maximum(sq[:, None] + sq - 2 * self.centroids @ self.centroids.T, 0))

    def probes(self, unit: np.ndarray, home: np.ndarray, step: float, apart: np.ndarray) -> Iterator[np.ndarray]:
        """The lists whose border with a vector's own list is within ``step``, for each vector."""
        sq = np.einsum("ij,ij->i", self.centroids, self.centroids)
        for a in range(0, len(unit), 1024):
            far = sq - 2 * unit[a:a + 1024] @ self.centroids.T
            h = home[a:a + 1024]
            far -= far[np.arange(len(far)), h][:, None]
            for row in far <= 2 * step * apart[h] + 1e-12:
                yield np.flatnonzero(row)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow."""
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


_PLACED = "key bigint, n bigint, v {vector}, dim int, home int, probes array<int>, code binary, miss double"


def _place(models: dict[int, Quantiser], step: float):
    """List, probes and code of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {d: m.border() for d, m in models.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                m = models[d]
                pick = pa.array(np.flatnonzero(dims == d))
                part = batch.take(pick)
                unit = unit_rows(matrix(part.column("v")))
                home = nearest(unit, m.centroids)
                codes, miss = m.code(unit, home)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("n"), part.column("v"), part.column("dim"),
                     pa.array(home.astype(np.int32)),
                     pa.array(list(m.probes(unit, home, step / np.sqrt(d), apart[d])), type=pa.list_(pa.int32())),
                     pa.array([c.tobytes() for c in codes], type=pa.binary()), pa.array(miss)],
                    names=["key", "n", "v", "dim", "home", "probes", "code", "miss"])
    return run


def shards_of_lists(sizes: list[tuple[int, int, int]], shard_rows: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(dim, list) -> (first shard, number of shards) from (dim, list, rows); neighbouring short lists share one."""
    out, shard, held, dim = {}, -1, None, None
    for d, home, rows in sorted(sizes):
        parts = max(1, -(-rows // shard_rows))
        if d == dim and parts == 1 and held is not None and held + rows <= shard_rows:
            held += rows
            out[d, home] = (shard, 1)
            continue
        shard += 1
        out[d, home] = (shard, parts)
        shard += parts - 1
        held, dim = (rows if parts == 1 else None), d
    return out


def _route(shards: dict[tuple[int, int], tuple[int, int]]):
    """Each vector once to its own shard (role 0) and once to every shard of the lists it probes (role 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, homes = batch.column("dim").to_pylist(), batch.column("home").to_pylist()
            keys = batch.column("key").to_pylist()
            own, asked, to = [], [], []
            for i, probes in enumerate(batch.column("probes")):
                first, parts = shards[dims[i], homes[i]]
                own.append(first + keys[i] % parts)
                visit_ = {s for p in probes.as_py() for a, k in (shards.get((dims[i], p), (0, 0)),) for s in range(a, a + k)}
                asked += [i] * len(visit_)
                to += sorted(visit_)
            n = len(own)
            names = ["key", "n", "v", "home", "probes", "code", "miss"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, type=pa.int32()), pa.array(np.zeros(n, dtype=np.int32))] + [batch.column(c) for c in names],
                names=["block", "role", *names])
            # one batch of queries for each ten thousand visits
            for a in range(0, len(asked), 10_000):
                some = batch.take(pa.array(asked[a:a + 10_000]))
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[a:a + 10_000], type=pa.int32()), pa.array(np.ones(k, dtype=np.int32))]
                    + [some.column(c) for c in names[:5]] + [pa.nulls(k, pa.binary()), pa.nulls(k, pa.float64())],
                    names=["block", "role", *names])
    return run


class Shard:
    """The coded vectors of some lists, and what their visitors find."""

    def __init__(self, models: dict[int, Quantiser], threshold: float):
        self.models, self.threshold = models, threshold
        self.reach = np.sqrt(max(0.0, 2 - 2 * threshold))
        self.parts: list[pa.RecordBatch] = []
        self.model = None

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _index(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        home = t.column("home").to_numpy()
        t = t.take(pa.array(np.argsort(home, kind="stable")))
        self.rows = matrix(t.column("v").combine_chunks())
        self.model = m = self.models[self.rows.shape[1]]
        self.key, self.n = t.column("key").to_numpy(), t.column("n").to_numpy()
        self.home = t.column("home").to_numpy()
        self.unit = unit_rows(self.rows)
        self.codes = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint8).reshape(len(self.key), -1)
        self.miss = t.column("miss").to_numpy()
        # what a coded distance has besides the products of the query with the codewords
        self.fixed = sum(((2 * m.centroids[self.home, a:b] + k[c]) * k[c]).sum(axis=1)
                         for k, c, a, b in zip(m.books, self.codes.T, m.edges[:-1], m.edges[1:]))
        self.lists = np.unique(self.home)
        self.begin = np.searchsorted(self.home, self.lists)
        self.until = np.append(self.begin[1:], len(self.home))
        probes = t.column("probes").combine_chunks()
        many = np.diff(probes.offsets.to_numpy())
        wide = len(m.centroids)
        self.visits = np.sort(np.repeat(np.arange(len(self.key)), many) * wide + probes.flatten().to_numpy())
        self.root = np.arange(len(self.key))
        self.credit = np.zeros(len(self.key), dtype=np.int64)
        self.parts = []

    def _near(self, unit: np.ndarray, lists: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) pairs whose coded distance leaves room for the threshold."""
        m = self.model
        table = [(k @ unit[:, a:b].T).astype(np.float32) for k, a, b in zip(m.books, m.edges[:-1], m.edges[1:])]
        far = np.square(unit[:, None, :] - m.centroids[None, self.lists]).sum(axis=2) if len(self.lists) * unit.size < 1 << 22 \
            else 1 + np.einsum("ij,ij->i", m.centroids, m.centroids)[self.lists] - 2 * unit @ m.centroids[self.lists].T
        who = np.repeat(np.arange(len(unit)), [len(x) for x in lists])
        where = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        for j, (l, a, b) in enumerate(zip(self.lists.tolist(), self.begin.tolist(), self.until.tolist())):
            q = who[where == l]
            if not len(q):
                continue
            product = np.zeros((b - a, len(q)), dtype=np.float32)
            for t, c in zip(table, self.codes[a:b].T):
                product += t[:, q][c]
            room = np.square(self.reach + self.miss[a:b] + 1e-4) + 1e-4
            hit = far[q, j] - 2 * product <= (room - self.fixed[a:b])[:, None]
            e, i = np.nonzero(hit)
            if len(e):
                yield q[i], e + a

    def _linked(self, rows: np.ndarray, unit: np.ndarray, q: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Which of the pairs have a cosine of the threshold or more."""
        out = np.empty(len(q), dtype=bool)
        for a in range(0, len(q), 1 << 16):
            i, j = q[a:a + (1 << 16)], e[a:a + (1 << 16)]
            cosine = np.einsum("ij,ij->i", unit[i], self.unit[j])
            out[a:a + (1 << 16)] = cosine >= self.threshold
            # by the definition itself where scaling first might round the other way
            near = np.flatnonzero(np.abs(cosine - self.threshold) < 1e-9)
            if len(near):
                x, y = rows[i[near]], self.rows[j[near]]
                x, y = x / np.abs(x).max(axis=1)[:, None], y / np.abs(y).max(axis=1)[:, None]
                dot = np.einsum("ij,ij->i", x, y)
                out[a + near] = dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) \
                    >= self.threshold
        return out

    def ask(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.model is None:
            if not self.parts:
                return
            self._index()
        rows = matrix(part.column("v"))
        unit = unit_rows(rows)
        key, n = part.column("key").to_numpy(), part.column("n").to_numpy()
        home = part.column("home").to_numpy()
        probes = [x.values.to_numpy() for x in part.column("probes")]
        wide = len(self.model.centroids)
        links, counts = [], np.zeros(len(key), dtype=np.int64)
        for a in range(0, len(key), _QUERIES):
            for q, e in self._near(unit[a:a + _QUERIES], probes[a:a + _QUERIES]):
                q = q + a
                q, e = (x[self.key[e] != key[q]] for x in (q, e))
                if not len(q):
                    continue
                yes = self._linked(rows, unit, q, e)
                q, e = q[yes], e[yes]
                if not len(q):
                    continue
                np.add.at(counts, q, self.n[e])
                # the row's own visit counts the link if it comes to this list
                code = e * wide + home[q]
                at = np.minimum(np.searchsorted(self.visits, code), len(self.visits) - 1)
                alone = self.visits[at] != code
                np.add.at(self.credit, e[alone], n[q[alone]])
                by = np.argsort(q, kind="stable")
                q, e = q[by], e[by]
                head = np.append(True, q[1:] != q[:-1])
                lead = e[head][np.cumsum(head) - 1]
                links.append((key[q[head]], self.key[e[head]]))
                more = self.root[lead] != self.root[e]
                if more.any():
                    self.root = local_roots(len(self.root), self.root[lead[more]], self.root[e[more]])[self.root]
        some = np.flatnonzero(counts)
        if len(some):
            yield self._frame(key[some], None, counts[some])
        if links:
            u, v = (np.concatenate(x) for x in zip(*links))
            yield self._frame(u, v, np.zeros(len(u), dtype=np.int64))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.model is None:
            return
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        if len(moved):
            yield self._frame(self.key[moved], self.key[self.root[moved]], np.zeros(len(moved), dtype=np.int64))
        some = np.flatnonzero(self.credit)
        if len(some):
            yield self._frame(self.key[some], None, self.credit[some])

    @staticmethod
    def _frame(u: np.ndarray, v: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(u), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v), pa.array(n)], names=["u", "v", "n"])


def fit(index: DataFrame, counts: dict[int, int], list_rows: int, max_lists: int, seed: int = 31) -> dict[int, Quantiser]:
    """A quantiser for each vector length, fitted on a bounded sample that a hash of the vector draws."""
    out = {}
    for dim, n in sorted(counts.items()):
        lists = min(max_lists, -(-n // list_rows))
        want = max(LEAST_SAMPLE, LIST_SAMPLE * lists)
        some = index.where(F.col("dim") == dim)
        if n > want:
            some = some.where(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 30)) < int(want / n * (1 << 30)))
        rows = matrix(some.select("v").toArrow().column("v").combine_chunks())
        rows = rows[np.lexsort(rows.T[::-1])]       # in one order, however the rows came
        out[dim] = Quantiser.fit(rows, lists, seed=seed)
    return out


def links(index: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, list_rows: int = LIST_ROWS,
          max_lists: int = MAX_LISTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v, n) from distinct vectors (key, v, n, dim): spanning links, and with null ``v`` numbers of links of ``u``."""
    counts = {r.dim: r.many for r in index.groupBy("dim").agg(F.count("*").alias("many")).collect()}
    models = fit(index, counts, list_rows, max_lists)
    step = reach * float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    vector = index.schema["v"].dataType.simpleString()
    placed = cut_lineage(index.select("key", "n", "v", "dim").mapInArrow(_place(models, step), _PLACED.format(vector=vector)))
    sizes = [(r.dim, r.home, r.many) for r in placed.groupBy("dim", "home").agg(F.count("*").alias("many")).collect()]
    routed = placed.mapInArrow(_route(shards_of_lists(sizes, shard_rows)),
                               f"block int, role int, key bigint, n bigint, v {vector}, home int, probes array<int>, "
                               "code binary, miss double")
    return (routed.repartition("block").sortWithinPartitions("block", "role")
            .mapInArrow(visit(lambda: Shard(models, threshold)), "u bigint, v bigint, n bigint"))


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, list_rows: int = LIST_ROWS,
                    max_lists: int = MAX_LISTS, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: links found at a cosine of ``threshold`` (above 0) or more.

    Each row is a vector of its own: equal vectors are linked with one another,
    repeated rows too.  ``component_id`` is the smallest id reachable, the row's
    own included; null ids name a component only where it has no other (then it
    is null); ``kept`` says that the id is the component's.  Vectors null,
    empty, zero or with null or non-finite components are linked with nothing,
    and only vectors of equal length are compared.  An empty table gives no rows.
    """
    kind = rows.schema[vec_col].dataType.simpleString()
    vector = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    given = rows.select(F.col(id_col).alias("id"), vector.alias("v")).withColumn("ok", usable("v", nonzero=True))
    # the number stays with the vector once it is written
    index = cut_lineage(given.where("ok").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first"))
                        .select(F.monotonically_increasing_id().alias("key"), "v", "n", "first", F.size("v").alias("dim")))
    found = cut_lineage(links(index, threshold, reach, list_rows, max_lists, shard_rows))
    many = found.where("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("others"))
    roots = components(found.where("v IS NOT NULL").select("u", "v")).select(F.col("node").alias("key"), "root")
    named = (index.join(many, "key", "left").join(roots, "key", "left")
             .select("v", "first", F.coalesce("root", "key").alias("root"),
                     (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_vector = named.join(least, "root").select("v", "n_links", "component_id")
    alone = given.where("NOT ok").select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
                                         F.col("id").alias("component_id"))
    linked = given.where("ok").join(by_vector, "v").select(F.col("id").alias(id_col), "n_links", "component_id")
    return linked.unionAll(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the exact answer over ``embeddings`` with different ids: all pairs, then smallest ids passed along links."""
    return f"""
    WITH RECURSIVE e AS (
        SELECT vec_id, embedding::double[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
    r(id, least) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.id WHERE r.least < l.b),
    c AS (SELECT id, min(least) AS component_id FROM r GROUP BY id),
    d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(component_id, vec_id) AS component_id,
           vec_id = coalesce(component_id, vec_id) AS kept
    FROM embeddings LEFT JOIN c ON id = vec_id LEFT JOIN d ON a = vec_id"""
