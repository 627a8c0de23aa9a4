"""Projections, filters and row transforms.

Top-N category lists (C3) stay DataFrames bounded by their ``limit``; they are
the only thing ever broadcast here, so broadcast size is proven by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col, key_hash


def select_columns(df: DataFrame, columns: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """Select ``columns``; a column absent from ``df`` becomes null, or ``''`` for text."""
    present = set(df.columns)
    out = []
    for c in columns:
        if c in present:
            out.append(F.col(c))
        elif c in text:
            out.append(F.lit("").alias(c))
        else:
            out.append(F.lit(None).cast("double").alias(c))
    return df.select(*out)


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop a row when any of ``subset`` is null (IsNotNull reaches the scan)."""
    return df.dropna(how="any", subset=list(subset))


def top_categories(df: DataFrame, column: str, n: int, name: str = "value") -> DataFrame:
    """The ``n`` most frequent non-null values of ``column``.

    Ties are broken by value.  The result has at most ``n`` rows (single
    column ``name``); it is a DataFrame, never collected.
    """
    return (df.where(F.col(column).isNotNull())
              .groupBy(F.col(column).alias(name)).count()
              .orderBy(F.desc("count"), F.asc(name))
              .limit(n)
              .select(name))


def keep_categories(df: DataFrame, column: str, categories: DataFrame | Sequence | None,
                    name: str = "value") -> DataFrame:
    """Keep rows whose ``column`` is one of ``categories``.

    ``categories`` is either a bounded DataFrame (a C3 result, broadcast for a
    ``left_semi`` join) or an explicit list (an ``isin`` filter).
    """
    if categories is None:
        return df
    if isinstance(categories, DataFrame):
        cats = categories.select(F.col(categories.columns[0]).alias("__cat"))
        return df.join(F.broadcast(cats), F.col(column) == F.col("__cat"), "left_semi")
    return df.where(F.col(column).isin(list(categories)))


def category_positions(categories: DataFrame, name: str = "value", pos: str = "pos") -> DataFrame:
    """0-based position of each category in sorted order (small table only)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col(name))
    return categories.select(F.col(name), (F.dense_rank().over(w) - 1).alias(pos))


def dodge_offset(color_pos: Column, n_colors: Column | int) -> Column:
    """Colour dodge ``0.8/k * (j - (k/2 - 1/2))`` inside a category slot."""
    k = F.lit(n_colors) if isinstance(n_colors, int) else n_colors
    return (F.lit(0.8) / k) * (color_pos - (k / 2.0 - 0.5))


def jitter(amount: float, n_colors: int, key: Column, seed: int = 42) -> Column:
    """uniform(-j, j) / 2 / k, a hash of ``key``: the same wherever the row lies."""
    if amount == 0:
        return F.lit(0.0)
    u = key_hash(key, salt=str(seed)) / float(1 << 32)
    return (u * 2.0 - 1.0) * amount / 2.0 / n_colors


def class_weights(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """C11: balanced class weight ``n / (k * n_c)`` appended as a column.

    The per-class table has one row per class; it is joined back (Spark picks a
    broadcast when AQE sees it is small) so the weights are computed once.
    """
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    from pyspark.sql import Window
    whole = Window.partitionBy()
    weights = per_class.select(
        label,
        (F.sum("__nc").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("__nc"))).alias(out))
    return df.join(weights, on=label, how="left")


def with_sample_weight(df: DataFrame, weight: str | None, out: str = "weight") -> DataFrame:
    """A ``weight`` column (1.0 when no weight column is given)."""
    if weight is None:
        return df.withColumn(out, F.lit(1.0))
    return df.withColumn(out, F.col(weight).cast("double"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
