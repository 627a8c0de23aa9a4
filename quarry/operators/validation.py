"""Holdout, train-test and k-fold assignment (V1-V5), fold scores (V6, V7).

Row membership is a pure function of a row key (first 32 bits of its md5),
so a split is the same on every run, on every cluster size and after any
executor loss -- no ``rand()``, no row order, no driver-side shuffling.  The
shares are exact in expectation, to one part in 2^32; the stratified variant is
exactly balanced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import key_hash
from ..sources.paging import numbered

HASHES = 1 << 32
FEW_GROUPS = 10_000       # groups up to which their numbers are broadcast


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def holdout_flag(key: str | Sequence[str], share: float = 0.1, salt: str | None = None):
    """Column: True for the ``share`` of rows held out (V1)."""
    return key_hash(*_keys(key), salt=salt) < F.lit(float(share) * HASHES)


def holdout_split(df: DataFrame, key: str | Sequence[str], share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """V1: (train, holdout).  Default 10 % held out."""
    flag = holdout_flag(key, share)
    return df.where(~flag), df.where(flag)


def train_test_split(df: DataFrame, key: str | Sequence[str], test_size: float = 0.1
                     ) -> tuple[DataFrame, DataFrame]:
    """V2: (train, test) inside the training rows, with a second (salted) hash."""
    flag = holdout_flag(key, test_size, salt="test")
    return df.where(~flag), df.where(flag)


def kfold(df: DataFrame, key: str | Sequence[str], k: int = 5, out: str = "fold") -> DataFrame:
    """V3: ``fold`` in 0..k-1 from a salted key hash."""
    if not 2 <= k:
        raise ValueError("k must be at least 2")
    return df.withColumn(out, (key_hash(*_keys(key), salt="fold") % k).cast("int"))


def stratified_kfold(df: DataFrame, key: str | Sequence[str], label: str, k: int = 5,
                     sub_buckets: int | None = None, out: str = "fold") -> DataFrame:
    """V4: per-class folds whose sizes differ by at most one.

    Rows of a class are ordered by key hash and dealt round-robin to the folds.
    The position of a row inside its class is computed without one task per
    class: the class is cut into ranges of the hash (``sub_buckets``, by
    default four for each shuffle partition), range sizes are prefix-summed on
    a small (classes x ranges) table, and rows are numbered inside their range
    only.  The folds don't depend on the number of ranges.
    """
    keys = _keys(key)
    ranges = sub_buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.withColumn("__h", key_hash(*keys, salt="fold"))
                .withColumn("__s", F.floor(F.col("__h") * F.lit(ranges / HASHES)).cast("int")))
    sizes = tagged.groupBy(label, "__s").agg(F.count(F.lit(1)).alias("__c"))
    offsets = sizes.select(F.col(label).alias("__l"), F.col("__s").alias("__s2"), (F.sum("__c").over(
        Window.partitionBy(label).orderBy("__s")) - F.col("__c")).alias("__o"))
    within = Window.partitionBy(label, "__s").orderBy("__h", *keys)
    numbered = (tagged.withColumn("__r", F.row_number().over(within))
                      .join(offsets, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__s") == F.col("__s2")))
                      .withColumn("__pos", F.col("__o") + F.col("__r") - 1))
    return numbered.withColumn(out, (F.col("__pos") % k).cast("int")).drop("__h", "__s", "__r", "__l", "__s2", "__o", "__pos")


def group_folds(df: DataFrame, group: str, out: str = "fold") -> DataFrame:
    """V5: leave-one-group-out -- the fold is the dense index of the group value.

    The distinct groups (which may be as many as users) are numbered range by
    range, not in one task.
    """
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    idx = numbered(groups, group).select(group, (F.col("#") - 1).cast("int").alias(out))
    if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        # a short list goes to the rows: shuffled, all rows of a group would meet in one task
        idx = F.broadcast(idx)
    return df.join(idx, group, "left")


def fold_summary(scores: DataFrame, score: str = "score", seconds: str | None = "seconds",
                 by: Sequence[str] = ()) -> DataFrame:
    """V6: mean, population std over folds and mean seconds (per ``by`` group)."""
    aggs = [F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
            F.count(F.lit(1)).alias("folds")]
    if seconds:
        aggs.append(F.avg(seconds).alias("seconds"))
    return scores.groupBy(*by).agg(*aggs)


def early_rejection(scores: DataFrame, best_mean: float, best_std: float, score: str = "score",
                    order: str = "fold") -> DataFrame:
    """V7: mark the fold after which a trial would have been stopped.

    Stop when the running mean < best_mean - 1.6 * best_std / sqrt(n - 1), n > 1.
    Returns the score table with ``running_mean`` and ``reject`` columns.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(w)
    running = F.avg(score).over(w)
    bound = F.lit(best_mean) - 1.6 * F.lit(best_std) / F.sqrt(n - 1)
    return scores.select("*", running.alias("running_mean"),
                         ((n > 1) & (running < bound)).alias("reject"))


def should_reject(fold_scores: list[float], best_mean: float | None, best_std: float | None) -> bool:
    """V7 on the driver, between folds: the same rule on the scores seen so far."""
    n = len(fold_scores)
    if n <= 1 or best_mean is None or best_std is None:
        return False
    return sum(fold_scores) / n < best_mean - 1.6 * best_std / (n - 1) ** 0.5
