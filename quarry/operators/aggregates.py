"""Grouped statistics (D1-D4, D7, D8, D12), stack offsets (W1) and sorting.

Each operator is one ``groupBy`` whose partial aggregation runs map-side, so a
hot key costs one row per map partition in the shuffle, never the raw rows.
Grids of empty (x, colour) pairs are built from the already aggregated table:
the colour categories are a scalar subquery (an array bounded by the caller's
top-N), exploded beside each x; no join of raw rows is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, same_group
from .statistics import FORMULAS, UserAggregate, modes, user_statistic

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def _agg_expr(name: str, y: Column, accuracy: int | None, order: Column | None = None) -> Column:
    """D3: map a pandas-style aggregate name to a Spark aggregate (``median`` only as a sketch: see callers)."""
    name = {"sd": "std", "average": "mean", "avg": "mean"}.get(name, name)
    table = {
        "count": lambda: F.count(y),
        "size": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(y),
        "mean": lambda: F.avg(y),
        "std": lambda: F.stddev_samp(y),
        "var": lambda: F.var_samp(y),
        "min": lambda: F.min(y),
        "max": lambda: F.max(y),
        "median": lambda: F.percentile_approx(y, F.lit(0.5), accuracy),
        "first": lambda: F.first(y, ignorenulls=True) if order is None else F.min_by(y, F.when(y.isNotNull(), order)),
        "last": lambda: F.last(y, ignorenulls=True) if order is None else F.max_by(y, F.when(y.isNotNull(), order)),
        **{known: lambda formula=formula: formula(y) for known, formula in FORMULAS.items()},
    }
    if name not in table:
        raise ValueError(f"unknown statistic {name!r}")
    return table[name]()


def full_grid(stats: DataFrame, x: str = "x", color: str = "color") -> DataFrame:
    """Every distinct ``x`` paired with every distinct ``color`` of ``stats``.

    ``stats`` is an aggregated table.  The colour list is one array value
    (scalar subquery), so the grid is produced by ``explode`` beside each x.
    """
    colors = stats.select(F.sort_array(F.collect_set(color)).alias("c"))
    return (stats.select(x).distinct()
                 .select(x, F.explode(colors.scalar()).alias(color)))


def stack_offsets(stats: DataFrame, value: str = "count", x: str = "x", color: str = "color",
                  out: str = "bottom") -> DataFrame:
    """Running total of ``value`` over colours (in order) before each bar, per x."""
    w = (Window.partitionBy(x).orderBy(color)
               .rowsBetween(Window.unboundedPreceding, -1))
    return stats.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")
                            if value == "count" else F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def categorical_stats(df: DataFrame, x: str, y: str | None = None, color: str | None = None,
                      stats: str | UserAggregate | Sequence[str | UserAggregate] | None = None,
                      accuracy: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Statistics of ``y`` by ``x`` [and ``color``].

    * ``stats=None`` or no ``y`` -> ``count`` of rows per group;
    * ``stats='quantiles'`` -> long form ``x, [color], quantile, y`` for
      10/25/50/75/90 % (exact; ``accuracy`` asks for the sketch instead);
    * a name or list of names (``mean``, ``std``, ``median``, ``mode``, ``skew``...)
      or of :class:`UserAggregate` -> one column each; ``order`` names the columns
      whose order ``first`` and ``last`` follow (without it, any value may be either).

    With a colour, every (x, colour) pair appears, count 0 / statistic null.
    """
    keys = [F.col(x).alias("x")] + ([F.col(color).alias("color")] if color else [])
    by = ["x"] + (["color"] if color else [])
    if stats is None or y is None:
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
        fill = {"count": 0}
    elif stats in ("quantiles", "quartiles"):
        levels = F.array(*[F.lit(q) for q in QUANTILES])
        wide = _group_quantiles(df.select(*keys, F.col(y).alias("y")), by, accuracy)
        if color:
            wide = full_grid(wide).join(wide, on=by, how="left")
        return wide.select(*by, F.posexplode(F.coalesce(
            F.col("q"), F.array_repeat(F.lit(None).cast("double"), len(QUANTILES)))).alias("i", "y")) \
            .select(*by, F.element_at(levels, F.col("i") + 1).alias("quantile"), "y")
    else:
        names = [stats] if isinstance(stats, (str, UserAggregate)) else list(stats)
        place = [F.struct(*order).alias("__order")] if order else []
        out = _named_stats(df.select(*keys, F.col(y).alias("y"), *place), by, names, accuracy)
        fill = {}
    if color:
        out = full_grid(out).join(out, on=by, how="left")
        if fill:
            out = out.fillna(fill)
    return out


def _keyed(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right`` for its groups, null being a group."""
    extra = [c for c in right.columns if c not in by]
    named = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], *extra)
    on = same_group(by, [f"__k{i}" for i in range(len(by))])
    return left.join(named, on, "left").drop(*[f"__k{i}" for i in range(len(by))])


def _group_quantiles(df: DataFrame, by: Sequence[str], accuracy: int | None) -> DataFrame:
    """(by..., q): the five plot quantiles of ``y`` for every group, null for one without values."""
    if accuracy is not None:
        return df.groupBy(*by).agg(F.percentile_approx("y", F.array(*map(F.lit, QUANTILES)), accuracy).alias("q"))
    return _keyed(df.select(*by).distinct(), exact_quantiles(df, by, "y", QUANTILES), by)


def _named_stats(df: DataFrame, by: Sequence[str], names: Sequence[str | UserAggregate], accuracy: int | None) -> DataFrame:
    """One column for each statistic.  Distinct counts, modes and exact medians come
    from counts per (group, value), users' statistics from merged states, beside the
    one aggregate of all other names."""
    apart = [n for n in names if isinstance(n, UserAggregate) or n in ("nunique", "mode") or (n == "median" and accuracy is None)]
    plain = [n for n in names if n not in apart]
    order = F.col("__order") if "__order" in df.columns else None
    out = df.groupBy(*by).agg(*[_agg_expr(n, F.col("y"), accuracy, order).alias(n) for n in plain or ["size"]])
    for n in apart:
        if isinstance(n, UserAggregate):
            found = user_statistic(df, by, "y", n)
        elif n == "nunique":
            found = df.select(*by, "y").distinct().groupBy(*by).agg(F.count("y").alias("nunique"))
        elif n == "mode":
            found = modes(df, by, "y")
        else:
            found = exact_quantiles(df, by, "y", [0.5]).select(*by, F.col("q")[0].alias("median"))
        out = _keyed(out, found, by)
    return out.select(*by, *[n.name if isinstance(n, UserAggregate) else n for n in names])


def quantiles_wide(df: DataFrame, x: str, y: str, color: str | None = None,
                   accuracy: int | None = None) -> DataFrame:
    """D2 in wide form: ``p10, q1, q2, q3, p90`` per (x[, colour])."""
    keys = [F.col(x).alias("x")] + ([F.col(color).alias("color")] if color else [])
    by = ["x"] + (["color"] if color else [])
    wide = _group_quantiles(df.select(*keys, F.col(y).alias("y")), by, accuracy)
    if color:
        wide = full_grid(wide).join(wide, on=by, how="left")
    names = ["p10", "q1", "q2", "q3", "p90"]
    return wide.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def bin_bounds(df: DataFrame, feature: str) -> DataFrame:
    """One-row min/max of ``feature`` widened by 0.5 when constant."""
    return (df.agg(F.min(feature).cast("double").alias("lo"), F.max(feature).cast("double").alias("hi"))
              .select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                      F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")))


def grouped_average_numeric(df: DataFrame, feature: str, bins: int = 10,
                            columns: Sequence[str] | None = None) -> DataFrame:
    """Count and mean of every other column in equal-width bins of ``feature``.

    Rows with a null feature are dropped first.  Every bin 0..bins-1 appears;
    an empty bin has count 0 and null means.  ``x`` is the bin centre.
    """
    data = df.where(F.col(feature).isNotNull())
    others = [c for c in (columns or data.columns) if c != feature]
    bounds = bin_bounds(data, feature)
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.least(F.floor((F.col(feature).cast("double") - lo) / width).cast("int"), F.lit(bins - 1))
    # bin as a projected column, so the bounds' subqueries stay out of the grouping keys
    stats = (data.withColumn("bin", b).groupBy("bin")
                 .agg(F.count(F.lit(1)).alias("count"), *[F.avg(c).alias(c) for c in others]))
    all_bins = data.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(stats, "bin", "left")
                    .select((lo + (F.col("bin") + 0.5) * width).alias("x"),
                            F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                            *[F.col(c) for c in others]))


def grouped_average_categoric(df: DataFrame, feature: str,
                              columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of each other column and the non-null count per category."""
    data = df.where(F.col(feature).isNotNull())
    others = [c for c in (columns or data.columns) if c != feature]
    return (data.groupBy(F.col(feature).alias("x"))
                .agg(F.count(F.col(others[0])).alias("count"), *[F.avg(c).alias(c) for c in others]))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
