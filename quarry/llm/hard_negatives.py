"""Hard negatives by segment summaries that are refined until the score is exact.

Every vector is cut into segments, and of each segment its mean m and deviation
s are stored.  The inner product of two segments of width w lies between
w (m m' - s s') and w (m m' + s s'), so the sums over all segments bound a
score from both sides.  For an anchor, rows whose bounds leave no room for an
answer are dropped at one segment, the others are looked at with four, then
sixteen, and what is left is scored exactly.

Two passes over blocks of all rows: the first finds each anchor's best rows of
its own label (only the upper bound counts there), the second its best rows of
other labels inside the band that each positive's score sets (both bounds
count).  Rows of equal label and vector are one index row with the smallest ids
among them, which is all that an answer can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import matrix, visit, whole, whole_products
from .vectors import usable

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
ANCHOR_STEP, RELABEL_STEP, LABELS = 50, 7, 10
#: least and most share of the positive's score that a negative may have, in hundredths
BAND = (50, 95)
BLOCK_ROWS = 8192
RESOLUTIONS = (1, 4, 16)


def summaries(rows: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(widths, means, deviations) of each row's segments; deviations around the means, so that none is rounded away."""
    dim = rows.shape[1]
    edges = np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(np.int64))
    width = np.diff(edges)
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.add.reduceat(rows, edges[:-1], axis=1) / width
        rest = rows - np.repeat(mean, width, axis=1)
        dev = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1) / width)
    return width, mean, dev


class Summaries:
    """The rows of one block, by label, with their segment summaries at every resolution."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, firsts: np.ndarray, resolutions: tuple = RESOLUTIONS):
        order = np.lexsort((firsts, labels))
        self.order, self.rows, self.firsts = order, rows[order], firsts[order]
        labels = labels[order]
        self.labels, begin = np.unique(labels, return_index=True)
        self.bounds = np.append(begin, len(labels))
        self.resolutions = resolutions
        self.levels = [summaries(self.rows, s) for s in resolutions]
        with np.errstate(over="ignore"):
            self.norm = np.sqrt(np.einsum("ij,ij->i", self.rows, self.rows))

    def own(self, label: int) -> slice:
        """The rows of a label."""
        i = int(np.searchsorted(self.labels, label))
        if i == len(self.labels) or self.labels[i] != label:
            return slice(0, 0)
        return slice(int(self.bounds[i]), int(self.bounds[i + 1]))

    def score_bounds(self, level: int, live: np.ndarray, query: list, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that the rows ``live`` can have with a query of these summaries."""
        width, mean, dev = self.levels[level]
        _, qm, qs = query[level]
        with np.errstate(over="ignore", invalid="ignore"):
            middle = mean[live] @ (width * qm)
            # above the rounding of the sums
            spread = dev[live] @ (width * qs) + 1e-9 * (norm * self.norm[live] + 1)
            low, high = middle - spread, middle + spread
        # a bound beyond the doubles says nothing
        return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)

    def _first(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` highest scores, ties to the smaller id."""
        # ~x orders longs from the highest, the least one included
        return np.lexsort((self.firsts[rows], ~score))[:k]

    def best(self, label: int, query: np.ndarray, stats: list, norm: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` best rows of a label."""
        live = np.arange(*self.own(label).indices(len(self.rows)))
        least = None
        for level in range(len(self.levels)):
            if len(live) <= k:
                break
            _, high = self.score_bounds(level, live, stats, norm)
            if least is None:
                some = live[np.argpartition(-high, k - 1)[:2 * k]]
                exact = np.sort(whole_products(self.rows[some], query))
                least = int(exact[-k]) if len(exact) >= k else None
            if least is not None:
                live = live[high >= least]
        score = whole_products(self.rows[live], query)
        pick = self._first(live, score, k)
        return live[pick], score[pick]

    def in_bands(self, label: int, query: np.ndarray, stats: list, norm: float, bands: list[tuple[int, int]],
                 k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(band, rows, scores): the ``k`` best rows of other labels with a score in each band, both ends included."""
        mine = self.own(label)
        live = np.append(np.arange(mine.start), np.arange(mine.stop, len(self.rows)))
        floors = [lo for lo, _ in bands]
        sure = False
        for level in range(len(self.levels)):
            if not len(live):
                return
            low, high = self.score_bounds(level, live, stats, norm)
            live, low, high = self._room(live, low, high, floors, bands)
            if not sure and len(live) > 8 * k:
                # rows that likely lie below a band's upper end give the first k-th best score of each
                guess = 0.5 * (np.maximum(low, -1e300) + np.minimum(high, 1e300))
                tops = sorted({hi for _, hi in bands})
                near = np.concatenate([np.argpartition(np.abs(guess - hi), 4 * k)[:4 * k] for hi in tops])
                exact = whole_products(self.rows[live[near]], query)
                exact = exact[np.unique(near, return_index=True)[1]]
                for i, (lo, hi) in enumerate(bands):
                    inside = np.sort(exact[(exact >= lo) & (exact <= hi)])
                    if len(inside) >= k:
                        floors[i] = int(inside[-k])
                live, low, high = self._room(live, low, high, floors, bands)
                sure = True
        score = whole_products(self.rows[live], query)
        for i, (lo, hi) in enumerate(bands):
            at = np.flatnonzero((score >= max(lo, floors[i])) & (score <= hi))
            if len(at):
                pick = at[self._first(live[at], score[at], k)]
                yield i, live[pick], score[pick]

    @staticmethod
    def _room(live, low, high, floors, bands):
        """Rows whose bounds meet a band above its floor."""
        keep = np.zeros(len(live), dtype=bool)
        for floor, (_, hi) in zip(floors, bands):
            if floor <= hi:
                keep |= (high >= floor) & (low <= hi)
        return live[keep], low[keep], high[keep]


def band(positive: int, share: tuple[int, int] = BAND) -> tuple[int, int]:
    """The least and the greatest whole score that has the stated share of a positive's."""
    return -(-share[0] * positive // 100), share[1] * positive // 100


class _Block:
    """One block's summaries and its anchors, which come with the scores of their positives in the second pass."""

    def __init__(self, scale: float, k: int, share: tuple[int, int] | None):
        self.scale, self.k, self.share = scale, k, share
        self.parts: list[pa.RecordBatch] = []
        self.index = None

    def hold(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def ask(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.index is None:
            if not self.parts:
                return
            t = pa.Table.from_batches(self.parts).combine_chunks()
            self.index = Summaries(whole(matrix(t.column("v").combine_chunks()), self.scale),
                                   t.column("label").to_numpy(), t.column("first").to_numpy())
            self.keys, self.parts = t.column("key").combine_chunks().take(pa.array(self.index.order)), []
        queries = whole(matrix(part.column("v")), self.scale)
        stats = [summaries(queries, s) for s in self.index.resolutions]
        with np.errstate(over="ignore"):
            norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        asked, rows, scores, positives = [], [], [], []
        for i, label in enumerate(part.column("label").to_pylist()):
            one = [(w, m[i], s[i]) for w, m, s in stats]
            if self.share is None:
                got = [(None, *self.index.best(label, queries[i], one, norms[i], self.k))]
            else:
                given = part.column("positives")[i].as_py()
                bands = [band(p, self.share) for p in given]
                got = [(given[j], r, s) for j, r, s in self.index.in_bands(label, queries[i], one, norms[i], bands, self.k)]
            for p, r, s in got:
                asked += [i] * len(r)
                rows.append(r)
                scores.append(s)
                positives += [p] * len(r)
        if asked:
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(asked)), self.keys.take(pa.array(np.concatenate(rows))),
                 pa.array(np.concatenate(scores)), pa.array(positives, type=pa.int64())],
                names=["anchor", "key", "score", "positive_score"])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from ()


_KEY = "struct<a: bigint, b: bigint>"


def _key(*of: str) -> Column:
    """128 bits of hash."""
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b"))


def _pass(index: DataFrame, anchors: DataFrame, blocks: int, scale: float, k: int, share: tuple[int, int] | None) -> DataFrame:
    """(anchor, key, score, positive_score) of each block's answers."""
    cols = ("key", "v", "label", "first", "positives")
    size = F.size("v")
    here = index.select("key", "v", "label", "first", F.lit(None).cast("array<bigint>").alias("positives"),
                        F.pmod("key.a", F.lit(blocks)).alias("b"), F.lit(0).alias("role"))
    there = anchors.select("key", "v", "label", F.lit(None).cast("bigint").alias("first"), "positives",
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("role"))
    dealt = here.unionAll(there).select(*cols, "role", F.concat_ws(":", size, F.col("b")).alias("block"))
    return (dealt.repartition("block").sortWithinPartitions("block", "role")
            .mapInArrow(visit(lambda: _Block(scale, k, share)), f"anchor {_KEY}, key {_KEY}, score bigint, positive_score bigint"))


def _first_ids(found: DataFrame, index: DataFrame, k: int, *group: str) -> DataFrame:
    """The ``k`` best index rows of each group, with the ids they stand for."""
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "first")
    return (found.join(index.select("key", "first", "ids"), "key").withColumn("n", F.row_number().over(order))
            .where(F.col("n") <= k).drop("n", "first", "key"))


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = BAND,
         scale: float = SCALE, anchor_step: int = ANCHOR_STEP, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id",
         vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Anchors are the rows whose id ``anchor_step`` divides; a component x counts
    as floor(scale x) and a score is the integer inner product (one that leaves
    64 bits counts as the largest long).  An anchor's positives are its best
    ``positives`` rows of the same label and another id, the negatives of a positive the best
    ``negatives`` rows of other labels whose score is ``share`` hundredths of
    the positive's; ties go to the smaller id.  A positive without such rows
    gives none.

    Null ids, null labels, and vectors null, empty or with null or non-finite
    components take no part; rows of equal id, label and vector count once;
    only vectors of equal length are compared; an empty table gives no rows.
    """
    good = (rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                        F.col(vec_col).alias("v"))
            .where("id IS NOT NULL AND label IS NOT NULL").where(usable("v", nonzero=False)))
    keep = max(positives + 1, negatives)
    index = cut_lineage(smallest_ids(good, keep).withColumn("key", _key("label", "v")))
    blocks = max(1, -(-index.count() // block_rows))
    asked = good.where(F.col("id") % anchor_step == 0).select("id", _key("label", "v").alias("anchor")).distinct()
    asked = cut_lineage(asked)
    anchors = cut_lineage(index.join(asked.select(F.col("anchor").alias("key")).distinct(), "key", "left_semi"))
    # one row more: the best may be the anchor's own
    none = anchors.withColumn("positives", F.lit(None).cast("array<bigint>"))
    found = _pass(index, none, blocks, scale, positives + 1, None)
    near = _first_ids(found.drop("positive_score"), index, positives + 1, "anchor")
    order = Window.partitionBy("id", "anchor").orderBy(F.col("score").desc(), "positive_id")
    pairs = cut_lineage(
        asked.join(near, "anchor").select("id", "anchor", F.col("score").alias("score"), F.explode("ids").alias("positive_id"))
        .where("id <> positive_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
        .select(F.col("id").alias("anchor_id"), "anchor", "positive_id", F.col("score").alias("positive_score")))
    # rows under one anchor share what they ask for
    wanted = pairs.groupBy(F.col("anchor").alias("key")).agg(F.collect_set("positive_score").alias("positives"))
    found = _pass(index, anchors.join(wanted, "key"), blocks, scale, negatives, share)
    far = _first_ids(found, index, negatives, "anchor", "positive_score")
    order = Window.partitionBy("anchor_id", "anchor", "positive_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    return (pairs.join(far, ["anchor", "positive_score"])
            .select("anchor_id", "anchor", "positive_id", "positive_score", F.col("score").alias("negative_score"),
                    F.explode("ids").alias("negative_id"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def smallest_ids(rows: DataFrame, keep: int) -> DataFrame:
    """(label, v, ids, first): every different (label, vector) with its ``keep`` smallest ids, reduced inside each batch first."""
    vector = rows.schema["v"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            place: dict[tuple, int] = {}
            for i, (own, label, v) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(),
                                                    batch.column("v"))):
                at = label, v.values.to_numpy(zero_copy_only=False).tobytes()
                groups.setdefault(at, []).append(own)
                place.setdefault(at, i)
            pick = pa.array(list(place.values()), type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").take(pick), batch.column("v").take(pick),
                 pa.array([sorted(set(x))[:keep] for x in groups.values()], type=pa.list_(pa.int64()))],
                names=["label", "v", "ids"])

    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return (rows.select("id", "label", "v").mapInArrow(local, f"label bigint, v {vector}, ids array<bigint>")
            .groupBy("label", "v").agg(merged.alias("ids")).withColumn("first", F.col("ids")[0]))


def relabelled(rows: DataFrame, step: int = RELABEL_STEP, labels: int = LABELS, id_col: str = "vec_id",
               label_col: str = "label") -> DataFrame:
    """The rows with label (label + 1) % ``labels`` where ``step`` divides the id: a known share of wrong labels."""
    moved = (F.col(label_col) + 1) % labels
    return rows.withColumn(label_col, F.when(F.col(id_col) % step == 0, moved).otherwise(F.col(label_col)))


def oracle_sql() -> str:
    """DuckDB SQL of :func:`mine` over relabelled ``embeddings`` with different ids."""
    lo, hi = BAND
    return f"""
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % {RELABEL_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
               list_transform(embedding, lambda x: floor({SCALE} * x::double)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label AS label,
                 list_dot_product(a.v, b.v)::hugeint AS score
          FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {ANCHOR_STEP} = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::int AS rank,
           id AS negative_id, positive_score::bigint AS positive_score, score::bigint AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND label <> anchor_label
        AND {lo} * positive_score <= 100 * score AND 100 * score <= {hi} * positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}"""
