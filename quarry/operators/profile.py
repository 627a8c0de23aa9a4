"""Column profiling (B3-B10): every statistic over all columns is one aggregate.

A single ``agg`` pass over the table computes per-column distinct counts, null
shares, minima, maxima and means; the one-row result is turned into one row
per column with ``inline`` (no driver round trip, no per-column job).
Exact distinct counts over many columns make Spark expand rows once per
column; ``approx=True`` switches to HyperLogLog (fixed-size buffers).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import is_numeric_type

NUMERIC, CATEGORIC, TEXT = "Numeric", "Categoric", "Text"

# Metric labels offered for a target (reference UI wording).
REGRESSION_METRICS = ("R Squared (Recommended)", "Mean Squared Error", "Mean Absolute Error",
                      "Median Absolute Error")
REGRESSION_NONNEG_METRIC = "Mean Squared Log Error"
CLASSIFICATION_METRICS = ("Log Loss (Recommended)", "Accuracy")
BINARY_METRIC = "ROC Area Under Curve"


def semantic_type(dt: T.DataType) -> str:
    return NUMERIC if is_numeric_type(dt) else CATEGORIC


def column_types(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, list[str]]:
    """B4 typing: split columns into nums / cats / text lists (schema + user override)."""
    overrides = overrides or {}
    out = {"nums": [], "cats": [], "text": []}
    for f in df.schema.fields:
        kind = overrides.get(f.name, semantic_type(f.dataType))
        out[{NUMERIC: "nums", CATEGORIC: "cats", TEXT: "text"}[kind]].append(f.name)
    return out


def _unique(c: Column, approx: bool) -> Column:
    distinct = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    # null counts as one more value
    return distinct + F.max(c.isNull().cast("int"))


def column_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """``#, Column, Type, Unique, Missing`` -- one row per column, one pass."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(_unique(c, approx).cast("long").alias(f"u{i}"))
        aggs.append(F.avg(c.isNull().cast("double")).alias(f"m{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(i + 1).alias("#"), F.lit(f.name).alias("Column"),
                     F.lit(semantic_type(f.dataType)).alias("Type"),
                     F.col(f"u{i}").alias("Unique"), F.col(f"m{i}").alias("Missing"))
            for i, f in enumerate(df.schema.fields)]
    return one.select(F.inline(F.array(*rows)))


def non_negative_columns(df: DataFrame) -> DataFrame:
    """Numeric columns with no negative value and no null (weight candidates)."""
    nums = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    if not nums:
        return df.sparkSession.createDataFrame([], "Column string")
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(nums):
        aggs += [F.min(F.col(f"`{c}`")).alias(f"lo{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("Column"),
                     (F.coalesce(F.col(f"lo{i}") >= 0, F.lit(True)) & (F.col(f"n{i}") == F.col("__n"))).alias("ok"))
            for i, c in enumerate(nums)]
    return one.select(F.inline(F.array(*rows))).where("ok").select("Column")


def frequencies(df: DataFrame, feature: str, max_categories: int = 10) -> DataFrame:
    """``Category, Count`` by count desc; empty when > ``max_categories`` distinct.

    The guard only ever looks at ``max_categories + 1`` groups (a scalar
    subquery over a ``limit``), so a high-cardinality column costs one
    aggregation, not a distinct count.
    """
    counts = (df.where(F.col(feature).isNotNull())
                .groupBy(F.col(feature).alias("Category")).agg(F.count(F.lit(1)).alias("Count")))
    too_many = counts.limit(max_categories + 1).select(F.count(F.lit(1))).scalar() > max_categories
    return counts.where(~too_many).orderBy(F.desc("Count"), F.asc("Category"))


def metric_suggestions(df: DataFrame, target: str, dtype: str) -> DataFrame:
    """Metric labels for a target, one row each (``#``, ``Metric``)."""
    c = F.col(target)
    if dtype == NUMERIC:
        names = [F.lit(m) for m in REGRESSION_METRICS]
        extra = F.when(F.coalesce(F.min(c) >= 0, F.lit(True)), F.lit(REGRESSION_NONNEG_METRIC))
    else:
        names = [F.lit(m) for m in CLASSIFICATION_METRICS]
        extra = F.when(_unique(c, False) == 2, F.lit(BINARY_METRIC))
    one = df.agg(extra.alias("extra"))
    arr = F.filter(F.array(*names, F.col("extra")), lambda m: m.isNotNull())
    return one.select(F.posexplode(arr).alias("#", "Metric")).withColumn("#", F.col("#") + 1)


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``Column, min, max, mean`` of numeric features, one pass."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"c{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("Column"), F.col(f"a{i}").alias("min"),
                     F.col(f"b{i}").alias("max"), F.col(f"c{i}").alias("mean"))
            for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def high_cardinality(df: DataFrame, limits: dict[str, int], approx: bool = False) -> DataFrame:
    """``Column, Unique, limit, top_only`` -- flag columns shown as top-N only."""
    cols = list(limits)
    aggs = [(F.approx_count_distinct(F.col(f"`{c}`")) if approx else F.count_distinct(F.col(f"`{c}`"))).alias(f"u{i}")
            for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("Column"), F.col(f"u{i}").alias("Unique"),
                     F.lit(limits[c]).alias("limit"), (F.col(f"u{i}") > limits[c]).alias("top_only"))
            for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def default_row(df: DataFrame, nums: Sequence[str], cats: Sequence[str] = (),
                text: Sequence[str] = ()) -> DataFrame:
    """One input row -- mean for numeric, null for categoric, '' for text."""
    cols = [F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in nums]
    cols += [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cats]
    cols += [F.lit("").alias(c) for c in text]
    return df.agg(*cols)
