"""Exact quantiles and ranks without a buffer of a whole group.

Values are counted per (group, value), so that copies of a value are one row.
The counts are cut into value ranges at quantiles of a sketch, range totals are
prefix-summed on a small (groups x ranges) table, and rows are ranked inside
their range only: a group with a third of all rows is as many tasks as there are
ranges.  The sketch decides where ranges end, never a result.  The counts are
written once to the shared checkpoint folder: cuts, totals and ranks read them there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_range(counts: DataFrame, value: str, out: str = "__b") -> DataFrame:
    """Append the index of each value's range: the number of cut points below it.

    Some four ranges for each shuffle partition; found by binary search in an
    array of cut points (a scalar subquery, no action here).
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = max(1, (4 * partitions - 1).bit_length())
    levels = [i / (1 << depth) for i in range(1, 1 << depth)]
    cuts = counts.select(F.percentile_approx(value, F.array(*map(F.lit, levels)), 10_000).alias("c")).scalar()
    steps = F.array(*[F.lit(1 << d) for d in reversed(range(depth))])
    # the cut points are named once, so that the plan holds their subquery once
    found = F.aggregate(steps, F.lit(0), lambda b, step: b + F.when(
        F.get("__cuts", b + step - 1) < F.col(value), step).otherwise(0))
    return counts.withColumn("__cuts", cuts).withColumn(out, found).drop("__cuts")


def same_group(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of group columns in which null is a group."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def cumulated(counts: DataFrame, by: Sequence[str], value: str, weights: Sequence[str], descending: bool = False) -> DataFrame:
    """Append ``<w>_upto`` (running sum in value order, own row included) and ``<w>_all`` for each weight column."""
    placed = with_range(cut_lineage(counts), value)
    totals = placed.groupBy(*by, "__b").agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    edge = F.desc("__b") if descending else F.asc("__b")
    before = Window.partitionBy(*by).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col("__b").alias("__ob"),
        *[F.coalesce(F.sum(f"__t_{w}").over(before), F.lit(0)).alias(f"__o_{w}") for w in weights],
        *[F.sum(f"__t_{w}").over(whole).alias(f"{w}_all") for w in weights])
    run = (Window.partitionBy(*by, "__b").orderBy(F.desc(value) if descending else F.asc(value))
                 .rowsBetween(Window.unboundedPreceding, 0))
    inside = placed.select("*", *[F.sum(w).over(run).alias(f"__r_{w}") for w in weights])
    joined = inside.join(offsets, same_group(by, [f"__g{i}" for i in range(len(by))]) & (F.col("__b") == F.col("__ob")))
    return joined.select(*counts.columns, *[(F.col(f"__o_{w}") + F.col(f"__r_{w}")).alias(f"{w}_upto") for w in weights],
                         *[f"{w}_all" for w in weights])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: Column | str, probs: Sequence[float],
                    weight: Column | None = None) -> DataFrame:
    """(by..., q): an array of the quantiles of the non-null values of each group.

    Unweighted: linear interpolation between the two nearest ranks.  Weighted:
    the least value whose cumulated weight reaches the share.  Groups without a
    value don't appear.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*[F.col(c).alias(c) for c in by], v.cast("double").alias("__v"),
                     (weight if weight is not None else F.lit(1)).alias("__w")).where(F.col("__v").isNotNull())
    counts = rows.groupBy(*by, "__v").agg(F.sum("__w").alias("n"))
    cum = cumulated(counts, by, "__v", ["n"])
    if weight is not None:
        picks = [F.min(F.when(F.col("n_upto") >= F.lit(p) * F.col("n_all"), F.col("__v"))) for p in probs]
    else:
        picks = []
        for p in probs:
            at = (F.col("n_all") - 1) * F.lit(float(p))
            low, high = (F.max(F.when((F.col("n_upto") - F.col("n") <= r) & (r < F.col("n_upto")), F.col("__v")))
                         for r in (F.floor(at), F.ceil(at)))
            part = F.max(at - F.floor(at))
            picks.append(low + (high - low) * part)
    return cum.groupBy(*by).agg(F.array(*picks).alias("q"))
