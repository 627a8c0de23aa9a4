"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint: the bitwise majority of the hashes of
its word shingles.  Two documents are linked when their fingerprints differ in
at most ``radius`` bits.

Candidate pairs come from a covering family of ``2^(radius+1) - 1`` bit masks:
each bit position carries a non-zero vector of ``radius + 1`` bits, and mask
``v`` keeps the positions whose vector has odd inner product with ``v``.  For
any ``radius`` differing positions some non-zero ``v`` is orthogonal to all of
their vectors, so that mask hides every difference: every pair within the
radius meets in at least one table, with certainty.

Only distinct fingerprints enter the tables.  A bucket longer than
``bucket_rows`` is dealt out again by a second covering family over the bits
its mask hides (about half of them); what then meets shares all but about 15
bits, so that a second-level bucket can't exceed some 2^15 fingerprints,
whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components, local_roots
from .identity import distinct_rows, row_key
from .textarrays import text_column

BITS = 64


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` lower-cased words, blanks made single spaces."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(ws) - words + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1:].tolist())),
                       dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; none for no hash."""
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 255 * 16):
        part = hashes[a:a + 255 * 16]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for b in range(0, len(bits), 255):
            ones += np.add.reduce(bits[b:b + 255], axis=0, dtype=np.uint8)
    out = 0
    for bit in (2 * ones > len(hashes)).tolist():
        out = out << 1 | bit
    return out


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every whole text; null and word-free texts get 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text").cast(pa.large_binary())
            fps = [majority(shingle_hashes(t.as_py(), words)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fp bigint")


def covering_masks(radius: int, positions: list[int], seed: int = 5) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are hidden together by one mask."""
    size = (1 << (radius + 1)) - 1
    rng = np.random.default_rng(seed)
    deal = np.concatenate([rng.permutation(size) + 1 for _ in range(-(-len(positions) // size))])
    masks = []
    for v in range(1, size + 1):
        masks.append(sum(1 << p for p, m in zip(positions, deal.tolist()) if bin(m & v).count("1") % 2))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``radius`` inside runs of equal keys (rows sorted by key).

    Compares all pairs of a run but returns a spanning set: each linked
    fingerprint with the first one it is joined to.  Links are merged as they
    are found, those between joined fingerprints are not looked at, and no list
    is longer than the rows.
    """
    n = len(fps)
    change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1 if n else np.zeros(0, dtype=np.int64)
    ends = np.repeat(np.append(change, n), np.diff(np.concatenate(([0], change, [n])))) if n else change
    live, d = np.arange(n), 0
    root = np.arange(n)
    while len(live):
        d += 1
        live = live[live + d < ends[live]]
        apart = live[root[live] != root[live + d]]
        near = apart[np.bitwise_count(fps[apart] ^ fps[apart + d]) <= radius]
        if len(near):
            root = local_roots(n, root[near], root[near + d])[root]
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _scan_buckets(radius: int, limit: int | None):
    """Reads rows sorted by (t, key, t2, key2); gives links, and the rows of buckets beyond ``limit`` for dealing again."""
    def frame(kind, t, u, v):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(u), kind, dtype=np.int8)), pa.array(t), pa.array(u), pa.array(v)],
            names=["big", "t", "u", "v"])

    def work(keys, fps):
        change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        size = np.diff(np.concatenate(([0], change, [len(fps)])))
        big = np.repeat(size > limit, size) if limit else np.zeros(len(fps), dtype=bool)
        if big.any():
            yield frame(1, keys[big, 0].astype(np.int32), fps[big].view(np.int64), fps[big].view(np.int64))
        k, f = keys[~big], fps[~big]
        a, b = link_runs(k, f, radius)
        if len(a):
            yield frame(0, np.zeros(len(a), dtype=np.int32), f[a].view(np.int64), f[b].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.uint64)
        over = None     # the bucket that is being passed on as too long
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                          for c in ("t", "key", "t2", "key2")], axis=1)
            keys = np.concatenate([keys, k])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if over is not None:
                same = np.flatnonzero(np.any(keys != over, axis=1))
                m = int(same[0]) if len(same) else len(fps)
                if m:
                    yield frame(1, keys[:m, 0].astype(np.int32), fps[:m].view(np.int64), fps[:m].view(np.int64))
                keys, fps = keys[m:], fps[m:]
                if not len(fps):
                    continue
                over = None
            # the last bucket may go on in the next batch
            other = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from work(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if limit and len(fps) > limit:
                over = keys[-1].copy()
                yield frame(1, keys[:, 0].astype(np.int32), fps.view(np.int64), fps.view(np.int64))
                keys, fps = keys[:0], fps[:0]
        if len(fps):
            yield from work(keys, fps)

    return run


def _with_keys(df: DataFrame, masks: list[int], t: str, key: str) -> DataFrame:
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)])
    return (df.withColumn("_m", F.explode(table))
            .withColumn(t, F.col("_m.t")).withColumn(key, F.col("fp").bitwiseAND(F.col("_m.m"))).drop("_m"))


def links(fps: DataFrame, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints of column ``fp`` within ``radius`` bits."""
    first = covering_masks(radius, list(range(BITS)))
    schema = "big tinyint, t int, u bigint, v bigint"
    dealt = _with_keys(fps.select("fp").distinct(), first, "t", "key").select(
        "t", "key", F.lit(0).alias("t2"), F.lit(0).cast("bigint").alias("key2"), "fp")
    out = cut_lineage(dealt.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
                      .mapInArrow(_scan_buckets(radius, bucket_rows), schema))
    # second family, over the bits that the first mask hides
    second = []
    for m in first:
        hidden = [p for p in range(BITS) if not m >> p & 1]
        second.append(covering_masks(radius, hidden, seed=6))
    table = F.array(*[F.array(*[F.lit(_signed(x)) for x in ms]) for ms in second])
    keys = F.array(*[F.lit(_signed(m)) for m in first])
    again = (out.where("big = 1").select("t", F.col("u").alias("fp"))
             .withColumn("key", F.col("fp").bitwiseAND(F.element_at(keys, F.col("t") + 1)))
             .select("t", "key", "fp", F.posexplode(F.element_at(table, F.col("t") + 1)).alias("t2", "_m"))
             .withColumn("key2", F.col("fp").bitwiseAND(F.col("_m"))).select("t", "key", "t2", "key2", "fp"))
    more = again.repartition("t", "key", "t2", "key2").sortWithinPartitions("t", "key", "t2", "key2", "fp").mapInArrow(
        _scan_buckets(radius, None), schema)
    return out.where("big = 0").select("u", "v").unionAll(more.select("u", "v"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """(id, fingerprint, component_id) of every document.

    ``component_id`` is the smallest id reachable over links, the document's
    own included.  Null and word-free texts have fingerprint zero and are
    linked like any other; repeated rows and equal ids simply share a
    component; a null id is returned with its component but never names one
    unless the whole component has null ids.  An empty table gives no rows.
    """
    fps = cut_lineage(fingerprints(docs, words, id_col, text_col))
    reps = fps.groupBy("fp").agg(F.min("id").alias("first_id"))
    roots = components(links(reps, radius, bucket_rows))
    named = (reps.join(roots, reps.fp == roots.node, "left")
             .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text",
                bucket_rows: int = 4096) -> DataFrame:
    """One row of each component: the least by (id, fingerprint, hash of the row), null ids last.

    Rows are chosen, not ids: different documents under one id, or under null,
    stay where they are no near copies; equal rows count once.  Only keys are
    compared; the rows themselves are dealt by their hash.
    """
    keyed = docs.select(F.struct(docs[id_col].alias("id"), *row_key(docs)).alias("_id"), docs[text_col].alias("_text"))
    fps = cut_lineage(fingerprints(keyed, words, "_id", "_text"))
    least = F.min(F.struct(F.col("id.id").isNull().alias("no_id"), "id.id", "fp", "id._a", "id._b"))
    reps = fps.groupBy("fp").agg(least.alias("first"))
    roots = components(links(reps, radius, bucket_rows))
    named = reps.join(roots, reps.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select("first._a", "first._b")
    return distinct_rows(docs).join(stay, ["_a", "_b"], "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
