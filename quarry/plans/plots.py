"""Plot datasets (P0-P4, P6): the numbers behind each chart, as DataFrames.

P0 builds the plot frame: type inference, top categories, null dropping,
binning or subsetting.  Counting and averaging plots on a categoric x are
planned from **one** pre-aggregation of the source by (x, colour), written
once to the shared checkpoint folder: the top-N lists and the final counts are
all derived from that small table, so the big table is scanned once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import is_numeric_type
from ..operators.aggregates import (categorical_stats, full_grid, quantiles_wide,
                                    stack_offsets)
from ..operators.rows import keep_categories, top_categories, dodge_offset, jitter as jitter_expr
from ..operators.text import text_stats
from ..session import cut_lineage

X_TOP = 25
COLOR_TOP = 10


@dataclass
class PlotFrame:
    """Result of P0: ``data`` has columns x, [y], [color]."""
    data: DataFrame
    x_type: str
    color: bool
    x_order: DataFrame | None = None        # bounded (<= 25 rows), column "value"
    color_order: DataFrame | None = None    # bounded (<= 10 rows), column "value"
    bin_width: Column | None = None
    extra: dict = field(default_factory=dict)


def infer_type(df: DataFrame, column: str) -> str:
    return "numeric" if is_numeric_type(df.schema[column].dataType) else "categoric"


def _order(df: DataFrame, column: str, given, n: int):
    if given is not None:
        return given if isinstance(given, DataFrame) else list(given)
    return top_categories(df, column, n)


def plot_frame(df: DataFrame, x: str, y: str | None = None, x_type: str | None = None,
               x_bins: int | None = None, x_order=None, color: str | None = None,
               color_order=None, keep: Sequence[str] = ()) -> PlotFrame:
    """The rows that get plotted.

    Top categories are chosen on the full column (before null dropping), then
    rows with a null in any used column are dropped, x is binned (numeric) or
    restricted to its top 25 (categoric), colour to its top 10.
    """
    x_type = x_type or infer_type(df, x)
    xo = _order(df, x, x_order, X_TOP) if x_type == "categoric" else None
    co = _order(df, color, color_order, COLOR_TOP) if color else None
    cols = [F.col(x).alias("x")]
    if y:
        cols.append(F.col(y).alias("y"))
    if color:
        cols.append(F.col(color).alias("color"))
    data = df.select(*cols, *keep).dropna(subset=["x"] + ["y"] * bool(y) + ["color"] * bool(color))
    width = None
    if x_type == "numeric" and x_bins:
        lo = data.agg(F.min("x").cast("double")).scalar()
        hi = data.agg(F.max("x").cast("double")).scalar()
        lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
        hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
        width = (hi2 - lo2) / F.lit(float(x_bins))
        b = F.least(F.floor((F.col("x").cast("double") - lo2) / width).cast("int"), F.lit(x_bins - 1))
        # label = right edge of the bin (1-based bin number times width)
        data = data.withColumn("x", lo2 + width * (b + 1))
    elif x_type == "categoric":
        data = keep_categories(data, "x", xo)
    if color:
        data = keep_categories(data, "color", co)
    return PlotFrame(data=data, x_type=x_type, color=bool(color), x_order=xo, color_order=co,
                     bin_width=width)


def _categoric_pre(df: DataFrame, x: str, color: str | None, y: str | None) -> DataFrame:
    """One aggregation of the source by (x, colour), nulls included.

    It is materialised in the shared checkpoint folder: its three consumers
    (top x, top colours, bars) would otherwise each re-scan the source, since
    Catalyst pushes their filters below the aggregate and no exchange is reused.
    """
    keys = [F.col(x).alias("x")] + ([F.col(color).alias("color")] if color else [])
    aggs = [F.count(F.lit(1)).alias("n_all")]
    if y:
        aggs += [F.count(F.col(y)).alias("n_y"), F.sum(F.col(y).cast("double")).alias("s_y")]
    return cut_lineage(df.groupBy(*keys).agg(*aggs))


def _top_from(pre: DataFrame, column: str, n: int) -> DataFrame:
    return (pre.where(F.col(column).isNotNull())
               .groupBy(F.col(column).alias("value")).agg(F.sum("n_all").alias("__n"))
               .orderBy(F.desc("__n"), F.asc("value")).limit(n).select("value"))


def count_plot(df: DataFrame, x: str, color: str | None = None, x_type: str | None = None,
               x_bins: int | None = 10, x_order=None, color_order=None,
               max_words: int = 25) -> DataFrame:
    """Bar heights and stack offsets.

    Columns: ``x, [color], count, bottom``; numeric x is binned (label = right
    edge), text x counts the top words.  Empty (x, colour) pairs have count 0.
    """
    x_type = x_type or infer_type(df, x)
    if x_type == "text":
        pf = plot_frame(df, x, x_type="text", color=color, color_order=color_order)
        stats = text_stats(pf.data, "x", color="color" if color else None, max_features=max_words)
    elif x_type == "categoric" and x_order is None and color_order is None:
        pre = _categoric_pre(df, x, color, None)
        xo = _top_from(pre, "x", X_TOP)
        rows = pre.where(F.col("x").isNotNull())
        rows = rows.join(F.broadcast(xo.withColumnRenamed("value", "x")), "x", "left_semi")
        if color:
            co = _top_from(pre, "color", COLOR_TOP)
            rows = rows.where(F.col("color").isNotNull()).join(
                F.broadcast(co.withColumnRenamed("value", "color")), "color", "left_semi")
        by = ["x"] + (["color"] if color else [])
        stats = rows.groupBy(*by).agg(F.sum("n_all").alias("count"))
        if color:
            stats = full_grid(stats).join(stats, by, "left").fillna({"count": 0})
    else:
        pf = plot_frame(df, x, x_type=x_type, x_bins=x_bins if x_type == "numeric" else None,
                        x_order=x_order, color=color, color_order=color_order)
        stats = categorical_stats(pf.data, "x", color="color" if color else None)
    if color:
        return stack_offsets(stats)
    return stats.withColumn("bottom", F.lit(0).cast("long"))


def mean_plot(df: DataFrame, x: str, y: str, color: str | None = None, x_type: str | None = None,
              x_bins: int | None = None, x_order=None, color_order=None) -> DataFrame:
    """Mean of ``y`` per x [and colour]; text x uses tf-weighted word means."""
    x_type = x_type or infer_type(df, x)
    if x_type == "text":
        pf = plot_frame(df, x, y, x_type="text", color=color, color_order=color_order)
        return text_stats(pf.data, "x", "y", color="color" if color else None).drop("count")
    if x_type == "categoric" and x_order is None and color_order is None:
        pre = _categoric_pre(df, x, color, y)
        xo = _top_from(pre, "x", X_TOP)
        rows = pre.where(F.col("x").isNotNull() & (F.col("n_y") > 0))
        rows = rows.join(F.broadcast(xo.withColumnRenamed("value", "x")), "x", "left_semi")
        by = ["x"]
        if color:
            co = _top_from(pre, "color", COLOR_TOP)
            rows = rows.where(F.col("color").isNotNull()).join(
                F.broadcast(co.withColumnRenamed("value", "color")), "color", "left_semi")
            by.append("color")
        stats = rows.groupBy(*by).agg((F.sum("s_y") / F.sum("n_y")).alias("mean"))
        if color:
            stats = full_grid(stats).join(stats, by, "left")
        return stats
    pf = plot_frame(df, x, y, x_type=x_type, x_bins=x_bins, x_order=x_order,
                    color=color, color_order=color_order)
    return categorical_stats(pf.data, "x", "y", color="color" if color else None, stats="mean")


def box_plot(df: DataFrame, x: str, y: str, color: str | None = None, x_order=None,
             color_order=None, accuracy: int | None = None) -> DataFrame:
    """p10, q1, median, q3, p90 of ``y`` per categoric x [and colour]."""
    pf = plot_frame(df, x, y, x_type="categoric", x_order=x_order, color=color,
                    color_order=color_order)
    return quantiles_wide(pf.data, "x", "y", color="color" if color else None, accuracy=accuracy)


def scatter_plot(df: DataFrame, x: str, y: str, color: str | None = None,
                 x_type: str | None = None, x_order=None, color_order=None,
                 jitter: float | None = None, seed: int = 42, key: str | None = None) -> DataFrame:
    """Point positions.  Categoric x maps to its slot in the sorted top-25
    list plus the colour dodge; ``jitter`` (default 0.5 for categoric x, else 0)
    adds seeded uniform noise, a hash of ``key`` (default: of the point itself), so
    that it doesn't move with the partitioning.  The reference's ``alpha`` is ignored there too.
    """
    x_type = x_type or infer_type(df, x)
    if jitter is None:
        jitter = 0.5 if x_type == "categoric" else 0.0
    noise = F.col(key).cast("string") if key else F.concat_ws("|", *[F.col(c).cast("string") for c in (x, y, color) if c])
    name = "__noise"
    pf = plot_frame(df.withColumn(name, noise), x, y, x_type=x_type, x_order=x_order, color=color, color_order=color_order,
                    keep=[name])
    out = pf.data
    n_colors = 1
    if x_type == "categoric":
        out = out.join(F.broadcast(_positions(df, pf.x_order, "x", "x_pos")), "x")
        pos = F.col("x_pos").cast("double")
    else:
        pos = F.col("x").cast("double")
    if color:
        cpos = _positions(df, pf.color_order, "color", "c_pos")
        n_colors = cpos.select(F.count(F.lit(1))).scalar()
        out = out.join(F.broadcast(cpos), "color")
        if x_type == "categoric":
            pos = pos + dodge_offset(F.col("c_pos").cast("double"), n_colors)
    pos = pos + jitter_expr(jitter, n_colors, seed=seed, key=F.col(name))
    cols = [pos.alias("x"), F.col("y")] + ([F.col("color")] if color else [])
    return out.select(*cols)


def _positions(df: DataFrame, order, name: str, pos: str) -> DataFrame:
    """Slot index of each category of a bounded order (top-N table or list)."""
    if not isinstance(order, DataFrame):
        order = df.sparkSession.createDataFrame([(v,) for v in order], "value string")
    return order.select(F.col("value").alias(name),
                        (F.dense_rank().over(Window.orderBy("value")) - 1).alias(pos))


def proportion_plot(df: DataFrame, x: str, color: str, kind: str = "proportion", **kw) -> DataFrame:
    """Documented in the reference but not drawn there.

    ``proportion``: share of each colour within an x bar; ``density``: share of
    each x within a colour.  Computed from the P1 counts (a small table).
    """
    counts = count_plot(df, x, color=color, **kw).drop("bottom")
    part = "x" if kind == "proportion" else "color"
    total = F.sum("count").over(Window.partitionBy(part))
    return counts.withColumn(kind, F.when(total > 0, F.col("count") / total))
