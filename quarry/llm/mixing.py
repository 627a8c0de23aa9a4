"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words, cut into blocks of ``block_words`` words.  A
source whose target exceeds its size is taken in several passes; the last pass
takes a prefix of a pseudo-random permutation of its blocks, so that the words
taken meet the target to the word.

The exact number of block slots of each source is its quota.  A binary tree
over the output shards splits the quotas: at each node the left half receives
a multivariate-hypergeometric draw, source after source, as if all the node's
slots were shuffled and cut.  Shards therefore get disjoint runs of each
source's permuted slots, sized like a true global shuffle, though no row was
shuffled to decide it.  Inside a shard the pieces are ordered by a hash.

Everything is DataFrame and SQL functions.  What grows with the documents is one count
of words for each text, sums by (source, bucket), a window inside each bucket, and
the piece list of each document; the tree holds sources x shards cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .identity import distinct_rows, row_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
SHARDS = 16
#: tasks that the rows of one shard are dealt over
SHARD_TASKS = 64
SEED = 17


def word_count(text: Column) -> Column:
    """Words of a text, blanks being the six ASCII ones; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, rank, source_size, target): the shares of the whole size, none above its cap.

    Raising one level until the sum of min(cap, level * weight) is the whole
    size gives what repeated resharing of the excess gives.  Sources are
    ordered by code point, null last; the weights repeat in that order.  One
    row for each source: the windows hold nothing that grows with the documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (total.withColumn("rank", F.row_number().over(by_name))
              .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                 (F.col("rank") - 1) % len(weights) + 1).cast("double"))
              .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    level = (ranked.withColumn("whole", F.sum("source_size").over(every))
             .withColumn("before", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
             .withColumn("level", (F.col("whole") - F.coalesce("before", F.lit(0.0))) / F.col("left"))
             .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
             .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"),
                                                                       F.col("level").alias("l")))).over(every)["l"]))
    return level.select("source", "rank", "source_size",
                        F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


# --- hypergeometric draws as SQL expressions ------------------------------------------------

def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _lgamma(z: str) -> str:
    """ln Gamma(z), z >= 1: Stirling's series at z + 8, taken back by the recurrence."""
    back = " * ".join(f"(g + {i}D)" for i in range(8))
    y = "(g + 8D)"
    return _let(f"double({z})", "g", f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {y})"
                f" - 1D / (360D * {y} * {y} * {y}) - ln({back}))")


def _ln_choose(n: str, k: str) -> str:
    return f"({_lgamma(f'{n} + 1')} - {_lgamma(f'{k} + 1')} - {_lgamma(f'{n} - ({k}) + 1')})"


def hypergeometric_sql(total: str, good: str, drawn: str, u: str) -> str:
    """How many of ``good`` among ``total`` are met in ``drawn`` draws, from a uniform ``u``.

    Inversion outwards from the mode: mode, +1, -1, +2, ... with the ratio of
    neighbouring probabilities; ten standard deviations reach every ``u`` that
    a double can tell apart from 1.
    """
    n, k, d = "p.n", "p.k", "p.d"
    sd = f"sqrt({d} * ({k} / {n}) * (1D - {k} / {n}) * ({n} - {d}) / greatest({n} - 1D, 1D))"
    up = f"(({k} - x) * ({d} - x) / ((x + 1D) * ({n} - {k} - {d} + x + 1D)))"
    down = f"(x * ({n} - {k} - {d} + x) / (({k} - x + 1D) * ({d} - x + 1D)))"
    step = _let(
        f"struct(a.up * {_let('p.mode + i - 1D', 'x', up)} AS up, a.dn * {_let('p.mode - i + 1D', 'x', down)} AS dn)", "r",
        "CASE WHEN a.u < r.up THEN named_struct('u', a.u, 'x', p.mode + i, 'up', r.up, 'dn', r.dn, 'done', true) "
        "WHEN a.u < r.up + r.dn THEN named_struct('u', a.u, 'x', p.mode - i, 'up', r.up, 'dn', r.dn, 'done', true) "
        "ELSE named_struct('u', a.u - r.up - r.dn, 'x', a.x, 'up', r.up, 'dn', r.dn, 'done', false) END")
    draw = _let(
        f"exp({_ln_choose(k, 'p.mode')} + {_ln_choose(f'({n} - {k})', f'({d} - p.mode)')} - {_ln_choose(n, d)})", "q",
        f"aggregate(sequence(1, int(ceil(10D * {sd})) + 30), "
        f"named_struct('u', {u} - q, 'x', p.mode, 'up', q, 'dn', q, 'done', {u} < q), "
        f"(a, i) -> CASE WHEN a.done THEN a ELSE {step} END, a -> bigint(a.x))")
    whole = (f"named_struct('n', double({total}), 'k', double({good}), 'd', double({drawn}), "
             f"'mode', floor((double({drawn}) + 1D) * (double({good}) + 1D) / (double({total}) + 2D)) * 1D)")
    return (f"CASE WHEN {good} <= 0 OR {drawn} <= 0 THEN 0L WHEN {drawn} >= {total} THEN bigint({good}) "
            f"WHEN {good} >= {total} THEN bigint({drawn}) ELSE {_let(whole, 'p', draw)} END")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, starts): for each source the first slot of every shard.

    ``quotas`` has ``rank`` and ``slots``, a row for each source.  Level by
    level, each tree node's quotas are split between its two halves.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "slots"))).alias("q")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    draw = hypergeometric_sql("s.rest", "c.slots", "s.left",
                              f"(shiftrightunsigned(xxhash64(lo, hi, c.rank, {int(seed)}), 11) / {float(1 << 53)!r}D)")
    for _ in range((shards - 1).bit_length()):
        nodes = (nodes.withColumn("mid", F.expr("(lo + hi + 1) div 2"))
                 .withColumn("total", F.expr("aggregate(q, 0L, (s, c) -> s + c.slots)"))
                 .withColumn("drawn", F.expr(
                     "aggregate(q, named_struct('rest', total, 'left', bigint(total * (mid - lo) div (hi - lo)), "
                     "'out', cast(array() as array<bigint>)), "
                     "(s, c) -> " + _let(draw, "x", "named_struct('rest', s.rest - c.slots, 'left', s.left - x, "
                                                    "'out', array_append(s.out, x))") + ", s -> s.out)")))
        halves = F.when(F.col("hi") - F.col("lo") <= 1, F.array(F.struct("lo", "hi", "q"))).otherwise(F.array(
            F.struct("lo", F.col("mid").alias("hi"),
                     F.expr("transform(q, (c, i) -> named_struct('rank', c.rank, 'slots', drawn[i]))").alias("q")),
            F.struct(F.col("mid").alias("lo"), "hi",
                     F.expr("transform(q, (c, i) -> named_struct('rank', c.rank, 'slots', c.slots - drawn[i]))").alias("q"))))
        nodes = cut_lineage(nodes.select(F.inline(halves)))
    cells = nodes.select("lo", F.inline("q"))
    by_shard = Window.partitionBy("rank").orderBy("lo")
    return (cells.withColumn("start", F.sum("slots").over(by_shard) - F.col("slots"))
            .groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("lo", "start"))).alias("s"))
            .select("rank", F.expr("transform(s, x -> x.start)").alias("starts")))


def _permuted(block: str, n: str, key: str) -> str:
    """A pseudo-random bijection of [0, n): rounds of a two-digit Feistel net, walked back into range."""
    def rounds(x: str) -> str:
        out = _let(f"named_struct('l', {x} div w.b, 'r', {x} % w.b)", "f0", "{}")
        for i in range(4):
            f = f"f{i}"
            moved = (f"named_struct('l', ({f}.l + pmod(xxhash64({f}.r, {key}, {i}), w.a)) % w.a, 'r', {f}.r)" if i % 2 == 0
                     else f"named_struct('l', {f}.l, 'r', ({f}.r + pmod(xxhash64({f}.l, {key}, {i}), w.b)) % w.b)")
            out = out.replace("{}", _let(moved, f"f{i + 1}", "{}"))
        return out.replace("{}", "f4.l * w.b + f4.r")
    wide = f"bigint(ceil(sqrt(double({n}))))"
    walk = (f"aggregate(sequence(1, 64), named_struct('v', {rounds(block)}), "
            f"(t, i) -> CASE WHEN t.v < {n} THEN t ELSE named_struct('v', {rounds('t.v')}) END, t -> t.v)")
    return _let(f"named_struct('a', {wide}, 'b', bigint(ceil({n} / double({wide}))))", "w", walk)


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS,
            shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", key_cols: tuple = ()) -> DataFrame:
    """One row per document: id, source, size, source_size, target, pieces, and ``key_cols``, which tell rows apart.

    ``pieces`` lists what the mix takes of the document: (shard, slot, epoch,
    start, words), ``start`` counting the document's words before it.  An epoch
    is one pass over the source; no word comes twice in one epoch, and there
    are at most ``max_repeats``.

    Null and empty texts have size 0 and no pieces; null sources are one
    source; repeated rows are separate documents; an empty table gives no rows.
    Equal input gives equal output, whatever its order and partitioning.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # rows are dealt by what they hold, so that neither a null nor a repeated id is one bucket; rows
    # without words take no place in the mix and go anywhere
    size = word_count(F.col(text_col))
    deal = F.when(size > 0, F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))).otherwise(
        F.xxhash64(F.monotonically_increasing_id()))
    sizes = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
                                    deal.alias("h"), *key_cols))
    rows = sizes.count()
    # as many buckets as rows in a bucket: neither the bucket list of a source nor a bucket grows faster than a root
    buckets = max(1, math.isqrt(rows))
    shared = targets(sizes, weights, max_repeats)
    b = int(block_words)
    quota = (shared.withColumn("want", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_repeats))
             .where("source_size > 0")
             .withColumn("blocks", F.expr(f"(source_size + {b - 1}) div {b}"))
             .withColumn("passes", F.expr("want div source_size"))
             .withColumn("rest", F.expr("want % source_size"))
             .withColumn("short", F.expr(f"source_size - (blocks - 1) * {b}"))
             .withColumn("short_at", F.expr(_permuted("(blocks - 1)", "blocks", f"rank, {seed}")))
             .withColumn("last", F.expr(f"CASE WHEN rest <= short_at * {b} THEN (rest + {b - 1}) div {b} "
                                        f"ELSE (rest + {b} - short + {b - 1}) div {b} END"))
             .withColumn("slots", F.expr("passes * blocks + last")))
    quota = cut_lineage(quota)
    starts = split_quotas(quota.select("rank", "slots"), shards, seed)
    plan = shared.join(quota.drop("source", "source_size", "target"), "rank", "left").join(starts, "rank", "left")

    placed = sizes.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = sums.select("source", "bucket", (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s"))
                         .alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "size", *key_cols).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.sum("size").over(inside) - F.col("size"))
    same = placed.source.eqNullSafe(before.source) & (placed.bucket == before.bucket)
    placed = placed.join(before, same).select(placed["*"], (F.col("at") + F.col("before")).alias("first"))
    rows_ = placed.join(plan, placed.source.eqNullSafe(plan.source)).select(
        placed.id, placed.source, "size", "source_size", "target", "first", "rank", "blocks", "passes", "rest", "short",
        "short_at", "starts", *key_cols)
    taken = _let(_permuted("k", "blocks", f"rank, {seed}"), "m", f"""
        transform(sequence(0L, passes), e -> named_struct(
            'shard', int(size(filter(starts, z -> z <= e * blocks + m)) - 1), 'slot', e * blocks + m, 'epoch', int(e),
            'start', greatest(first, k * {b}) - first,
            'words', least(first + size, k * {b} + CASE WHEN e < passes THEN {b} ELSE
                     least({b}L, greatest(0L, rest - m * {b} + if(m > short_at, {b} - short, 0))) END) - greatest(first, k * {b})))""")
    pieces = f"""CASE WHEN size > 0 THEN filter(flatten(transform(
        sequence(first div {b}, (first + size - 1) div {b}), k -> {taken})), p -> p.words > 0) END"""
    empty = "cast(array() as array<struct<shard:int,slot:bigint,epoch:int,start:bigint,words:bigint>>)"
    return rows_.select(F.col("id").cast(kind).alias(id_col), F.col("source").alias(source_col), "size", "source_size",
                        "target", F.coalesce(F.expr(pieces), F.expr(empty)).alias("pieces"), *key_cols)


def digest(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, size, source_size, target, the words taken, repeats counted, and how many of them each shard takes."""
    shards = """transform(array_sort(array_distinct(transform(pieces, p -> p.shard))), z -> named_struct(
        'shard', z, 'words', aggregate(filter(pieces, p -> p.shard = z), 0L, (s, p) -> s + p.words)))"""
    return mixed.select(id_col, "size", "source_size", "target",
                        F.expr("aggregate(pieces, 0L, (s, p) -> s + p.words)").alias("taken"),
                        F.expr(shards).alias("shard_words"))


def shard_pieces(mixed: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself: every piece with its shard, in random order inside each shard.

    Shards are range-partitioned with their order key, so that a large shard is
    several tasks.
    """
    rows = mixed.select(id_col, source_col, F.inline("pieces")).withColumn(
        "order_key", F.xxhash64("slot", "start", id_col, F.lit(seed)))
    return rows.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    seed: int = SEED, **options) -> DataFrame:
    """The documents as the mix takes them: a row for each document and epoch, with the words taken.

    A row stands in the shard that the splitting tree gave its first words, in
    random order there; a shard is dealt over ``SHARD_TASKS`` tasks.  A document taken whole keeps its text as it is; of one cut by a block's
    edge the taken words are joined by one space.  Rows are joined by what they
    hold, so that null and repeated ids multiply nothing.  Extra columns are kept.
    """
    keyed = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].alias("source"), *row_key(docs))
    mixed = mixture(keyed, id_col="id", text_col="text", source_col="source", key_cols=("_a", "_b"),
                    seed=seed, **options)
    epochs = mixed.select("_a", "_b", "size", F.explode(F.expr(
        "transform(array_sort(array_distinct(transform(pieces, p -> p.epoch))), "
        "e -> array_sort(transform(filter(pieces, p -> p.epoch = e), p -> named_struct('start', p.start, 'words', p.words, "
        "'shard', p.shard, 'slot', p.slot))))")).alias("parts"))
    joined = (distinct_rows(docs).join(epochs, ["_a", "_b"])
              .select("row", "size", "parts", F.col("row")[text_col].alias("text"), F.col("parts")[0]["shard"].alias("shard"),
                      F.xxhash64(F.col("parts")[0]["slot"], "_a", "_b", F.lit(seed)).alias("order_key")))
    whole = F.expr("aggregate(parts, 0L, (s, p) -> s + p.words) = size")
    cut = F.expr(f"array_join(flatten(transform(parts, p -> slice(regexp_extract_all(text, r'{WORD}', 0), "
                 "int(p.start) + 1, int(p.words)))), ' ')")
    text = F.when(whole, F.col("text")).otherwise(cut)
    out = joined.select("shard", "order_key", F.struct(*[(text if c == text_col else F.col("row")[c]).alias(c)
                                                         for c in docs.columns]).alias("row"))
    dealt = (out.repartition("shard", F.pmod("order_key", F.lit(SHARD_TASKS)))
             .sortWithinPartitions("shard", "order_key"))
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns])
