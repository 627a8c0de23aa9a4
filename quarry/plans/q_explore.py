"""Registered queries: sources, profiling, row transforms, grouped statistics, plots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expressions import key_hash_sql
from ..operators import aggregates as A
from ..operators import profile as B
from ..operators import rows as C
from ..operators.statistics import UserAggregate
from ..sources import paging
from . import plots as P
from .catalog import query


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _orders_with_nulls(t):
    """orders with nulls injected the same way in both engines."""
    o = t("orders")
    return o.select("o_orderkey", "o_custkey",
                    F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"),
                    F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END").alias("o_totalprice"),
                    "o_orderdate", "o_orderpriority")


ORDERS_NULLS = """(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders)"""


# --- P1 count plot: categoric x, colour -------------------------------------------------

@query("count_plot", f"""
WITH pre AS (SELECT o_orderpriority AS x, o_orderstatus AS color FROM orders),
xo AS (SELECT x AS v FROM pre WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 25),
co AS (SELECT color AS v FROM pre WHERE color IS NOT NULL GROUP BY color ORDER BY count(*) DESC, color LIMIT 10),
pd AS (SELECT x, color FROM pre WHERE x IS NOT NULL AND color IS NOT NULL
       AND x IN (SELECT v FROM xo) AND color IN (SELECT v FROM co)),
st AS (SELECT x, color, count(*) AS n FROM pd GROUP BY x, color),
grid AS (SELECT a.x, b.color FROM (SELECT DISTINCT x FROM pd) a, (SELECT DISTINCT color FROM pd) b)
SELECT g.x, g.color, CAST(coalesce(st.n, 0) AS BIGINT) AS count,
  CAST(coalesce(sum(coalesce(st.n, 0)) OVER (PARTITION BY g.x ORDER BY g.color
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom
FROM grid g LEFT JOIN st ON g.x = st.x AND g.color = st.color
""")
def count_plot(t):
    """P1 (C3, C4, D1, D4, W1): orders by priority, stacked by status."""
    return P.count_plot(t("orders"), "o_orderpriority", color="o_orderstatus")


@query("count_plot_nulls", f"""
WITH pre AS (SELECT o_orderstatus AS x, o_orderpriority AS color FROM {ORDERS_NULLS}),
xo AS (SELECT x AS v FROM pre WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 25),
co AS (SELECT color AS v FROM pre WHERE color IS NOT NULL GROUP BY color ORDER BY count(*) DESC, color LIMIT 10),
pd AS (SELECT x, color FROM pre WHERE x IS NOT NULL AND color IS NOT NULL
       AND x IN (SELECT v FROM xo) AND color IN (SELECT v FROM co)),
st AS (SELECT x, color, count(*) AS n FROM pd GROUP BY x, color),
grid AS (SELECT a.x, b.color FROM (SELECT DISTINCT x FROM pd) a, (SELECT DISTINCT color FROM pd) b)
SELECT g.x, g.color, CAST(coalesce(st.n, 0) AS BIGINT) AS count,
  CAST(coalesce(sum(coalesce(st.n, 0)) OVER (PARTITION BY g.x ORDER BY g.color
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom
FROM grid g LEFT JOIN st ON g.x = st.x AND g.color = st.color
""")
def count_plot_nulls(t):
    """P1 with injected nulls (C2): null status rows are dropped."""
    return P.count_plot(_orders_with_nulls(t), "o_orderstatus", color="o_orderpriority")


@query("count_plot_many", """
WITH pre AS (SELECT p_name AS x FROM part),
xo AS (SELECT x AS v FROM pre WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 25)
SELECT x, CAST(count(*) AS BIGINT) AS count, CAST(0 AS BIGINT) AS bottom
FROM pre WHERE x IN (SELECT v FROM xo) GROUP BY x
""")
def count_plot_many(t):
    """P1 on a high-cardinality column: only the top 25 names (ties by value)."""
    return P.count_plot(t("part"), "p_name")


_BINNED_SQL = """
WITH pre AS (SELECT {x} AS x, {color} AS color FROM {src}),
co AS (SELECT color AS v FROM pre WHERE color IS NOT NULL GROUP BY color ORDER BY count(*) DESC, color LIMIT 10),
d AS (SELECT CAST(x AS DOUBLE) AS x, color FROM pre WHERE x IS NOT NULL AND color IS NOT NULL),
b0 AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
b AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM b0),
pd AS (SELECT lo + ((hi - lo) / {bins}.0) * (least(CAST(floor((x - lo) / ((hi - lo) / {bins}.0)) AS INTEGER), {bins} - 1) + 1) AS x,
       color FROM d, b WHERE color IN (SELECT v FROM co)),
st AS (SELECT x, color, count(*) AS n FROM pd GROUP BY x, color),
grid AS (SELECT a.x, c.color FROM (SELECT DISTINCT x FROM pd) a, (SELECT DISTINCT color FROM pd) c)
SELECT round(g.x, 6) AS x, g.color, CAST(coalesce(st.n, 0) AS BIGINT) AS count,
  CAST(coalesce(sum(coalesce(st.n, 0)) OVER (PARTITION BY g.x ORDER BY g.color
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom
FROM grid g LEFT JOIN st ON g.x = st.x AND g.color = st.color
"""


@query("count_plot_binned", _BINNED_SQL.format(x="o_totalprice", color="o_orderstatus", src="orders", bins=10))
def count_plot_binned(t):
    """P1 with numeric x in 10 equal-width bins (C5: label = right edge)."""
    return P.count_plot(t("orders"), "o_totalprice", color="o_orderstatus", x_bins=10)


@query("count_plot_constant", _BINNED_SQL.format(x="l_quantity * 0 + 3", color="l_returnflag",
                                                 src="lineitem", bins=5))
def count_plot_constant(t):
    """P1 on a constant column: bin edges widened by 0.5 on each side."""
    li = t("lineitem").withColumn("c", F.col("l_quantity") * 0 + 3)
    return P.count_plot(li, "c", color="l_returnflag", x_bins=5)


# --- P2 mean plot, P3 box plot, P4 scatter, P6 proportion -------------------------------

@query("mean_plot", """
WITH pre AS (SELECT o_orderpriority AS x, o_totalprice AS y, o_orderstatus AS color FROM {src}),
xo AS (SELECT x AS v FROM pre WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 25),
co AS (SELECT color AS v FROM pre WHERE color IS NOT NULL GROUP BY color ORDER BY count(*) DESC, color LIMIT 10),
pd AS (SELECT x, y, color FROM pre WHERE x IS NOT NULL AND y IS NOT NULL AND color IS NOT NULL
       AND x IN (SELECT v FROM xo) AND color IN (SELECT v FROM co)),
st AS (SELECT x, color, avg(y) AS m FROM pd GROUP BY x, color),
grid AS (SELECT a.x, b.color FROM (SELECT DISTINCT x FROM pd) a, (SELECT DISTINCT color FROM pd) b)
SELECT g.x, g.color, round(st.m, 6) AS mean FROM grid g LEFT JOIN st ON g.x = st.x AND g.color = st.color
""".format(src=ORDERS_NULLS))
def mean_plot(t):
    """P2 (D3 'mean'): mean total price by priority and status, nulls injected."""
    return P.mean_plot(_orders_with_nulls(t), "o_orderpriority", "o_totalprice", color="o_orderstatus")


@query("mean_plot_binned", """
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
pd AS (SELECT lo + ((hi - lo) / 8.0) * (least(CAST(floor((x - lo) / ((hi - lo) / 8.0)) AS INTEGER), 7) + 1) AS x, y FROM d, b)
SELECT round(x, 6) AS x, round(avg(y), 6) AS mean FROM pd GROUP BY x
""")
def mean_plot_binned(t):
    """P2 with numeric x in 8 bins (line style)."""
    return P.mean_plot(t("lineitem"), "l_quantity", "l_extendedprice", x_bins=8)


@query("box_plot", """
WITH pre AS (SELECT o_orderpriority AS x, o_totalprice AS y, o_orderstatus AS color FROM {src}),
xo AS (SELECT x AS v FROM pre WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 25),
co AS (SELECT color AS v FROM pre WHERE color IS NOT NULL GROUP BY color ORDER BY count(*) DESC, color LIMIT 10),
pd AS (SELECT x, y, color FROM pre WHERE x IS NOT NULL AND y IS NOT NULL AND color IS NOT NULL
       AND x IN (SELECT v FROM xo) AND color IN (SELECT v FROM co)),
st AS (SELECT x, color, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.25) AS q1,
              quantile_cont(y, 0.5) AS q2, quantile_cont(y, 0.75) AS q3, quantile_cont(y, 0.9) AS p90
       FROM pd GROUP BY x, color),
grid AS (SELECT a.x, b.color FROM (SELECT DISTINCT x FROM pd) a, (SELECT DISTINCT color FROM pd) b)
SELECT g.x, g.color, round(p10, 6) AS p10, round(q1, 6) AS q1, round(q2, 6) AS q2,
       round(q3, 6) AS q3, round(p90, 6) AS p90
FROM grid g LEFT JOIN st ON g.x = st.x AND g.color = st.color
""".format(src=ORDERS_NULLS))
def box_plot(t):
    """P3 (D2 quantiles, wide): exact linear-interpolation percentiles."""
    return P.box_plot(_orders_with_nulls(t), "o_orderpriority", "o_totalprice", color="o_orderstatus")


@query("quantiles_long", """
SELECT l_returnflag AS x, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS quantile,
       round(unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.75, 0.9])), 6) AS y
FROM lineitem GROUP BY l_returnflag
""")
def quantiles_long(t):
    """D2 long form (the reference's 'quantiles' statistics)."""
    return A.categorical_stats(t("lineitem"), "l_returnflag", "l_extendedprice", stats="quantiles")


@query("scatter_plot", """
WITH pre AS (SELECT o_orderpriority AS x, o_totalprice AS y, o_orderstatus AS color FROM orders),
xo AS (SELECT x AS v, dense_rank() OVER (ORDER BY x) - 1 AS pos FROM
       (SELECT x FROM pre WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 25)),
co AS (SELECT color AS v, dense_rank() OVER (ORDER BY color) - 1 AS pos FROM
       (SELECT color FROM pre WHERE color IS NOT NULL GROUP BY color ORDER BY count(*) DESC, color LIMIT 10)),
k AS (SELECT count(*) AS k FROM co)
SELECT round(xo.pos + (0.8 / k.k) * (co.pos - (k.k / 2.0 - 0.5)), 6) AS x, round(y, 6) AS y, color
FROM pre JOIN xo ON pre.x = xo.v JOIN co ON pre.color = co.v, k
WHERE y IS NOT NULL
""")
def scatter_plot(t):
    """P4 (C9 slot + dodge, C10 jitter=0): point positions for every order."""
    return P.scatter_plot(t("orders"), "o_orderpriority", "o_totalprice", color="o_orderstatus", jitter=0.0)


@query("proportion_plot", """
WITH pre AS (SELECT l_returnflag AS x, l_linestatus AS color FROM lineitem),
st AS (SELECT x, color, count(*) AS n FROM pre GROUP BY x, color),
grid AS (SELECT a.x, b.color FROM (SELECT DISTINCT x FROM pre) a, (SELECT DISTINCT color FROM pre) b),
g AS (SELECT g.x, g.color, coalesce(st.n, 0) AS n FROM grid g LEFT JOIN st ON g.x = st.x AND g.color = st.color)
SELECT x, color, CAST(n AS BIGINT) AS count, round(n / sum(n) OVER (PARTITION BY x), 6) AS proportion FROM g
""")
def proportion_plot(t):
    """Share of each colour inside each bar (documented in the reference, not built there)."""
    return P.proportion_plot(t("lineitem"), "l_returnflag", "l_linestatus")


# --- grouped averages D7/D8 ---------------------------------------------------------------

@query("grouped_average_numeric", """
WITH d AS (SELECT CAST(l_discount AS DOUBLE) AS f, l_extendedprice, l_quantity FROM lineitem WHERE l_discount IS NOT NULL),
b0 AS (SELECT min(f) AS lo, max(f) AS hi FROM d),
b AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM b0),
st AS (SELECT least(CAST(floor((f - lo) / ((hi - lo) / 20.0)) AS INTEGER), 19) AS bin, count(*) AS n,
              avg(l_extendedprice) AS l_extendedprice, avg(l_quantity) AS l_quantity FROM d, b GROUP BY bin),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT round(lo + (bins.bin + 0.5) * ((hi - lo) / 20.0), 6) AS x, CAST(coalesce(n, 0) AS BIGINT) AS count,
       round(st.l_extendedprice, 6) AS l_extendedprice, round(st.l_quantity, 6) AS l_quantity
FROM bins CROSS JOIN b LEFT JOIN st ON bins.bin = st.bin
""")
def grouped_average_numeric(t):
    """20 bins of discount (empty bins kept with count 0, null means; label = centre)."""
    li = t("lineitem").select("l_discount", "l_extendedprice", "l_quantity")
    return A.grouped_average_numeric(li, "l_discount", bins=20)


@query("grouped_average_categoric", f"""
SELECT o_orderpriority AS x, count(o_totalprice) AS count, round(avg(o_totalprice), 6) AS o_totalprice,
       round(avg(o_custkey), 6) AS o_custkey
FROM {ORDERS_NULLS} WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
""")
def grouped_average_categoric(t):
    """Means per category, count of the first other column's non-null values."""
    o = _orders_with_nulls(t).select("o_orderpriority", "o_totalprice", "o_custkey")
    return A.grouped_average_categoric(o, "o_orderpriority")


@query("group_stats", """
SELECT l_returnflag AS x, l_linestatus AS color, round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
       round(max(l_extendedprice), 6) AS max, round(median(l_extendedprice), 6) AS median,
       CAST(count(DISTINCT l_extendedprice) AS BIGINT) AS nunique
FROM lineitem GROUP BY ALL
""")
def group_stats(t):
    """D3: several named statistics per (x, colour) grid cell."""
    return A.categorical_stats(t("lineitem"), "l_returnflag", "l_extendedprice", color="l_linestatus",
                               stats=["mean", "std", "min", "max", "median", "nunique"])


@query("group_shape", """
SELECT o_orderpriority AS x, round(stddev_samp(o_totalprice) / sqrt(count(o_totalprice)), 6) AS sem,
       round(skewness(o_totalprice), 6) AS skew, round(kurtosis(o_totalprice), 6) AS kurt,
       round(max(o_totalprice) - min(o_totalprice), 6) AS ptp,
       round(arg_min(o_totalprice, o_orderkey), 6) AS first, round(arg_max(o_totalprice, o_orderkey), 6) AS last,
       round(exp(avg(ln(o_totalprice))), 4) AS geometric_mean
FROM orders GROUP BY o_orderpriority
""")
def group_shape(t):
    """D3: statistics with a finishing formula, first and last in key order, and a user's own aggregate."""
    geometric = UserAggregate("geometric_mean", lambda v: [np.log(v).sum(), len(v)], lambda s: s.sum(axis=0),
                              lambda s: np.exp(s[0] / s[1]))
    names = ["sem", "skew", "kurt", "ptp", "first", "last"]
    out = A.categorical_stats(t("orders"), "o_orderpriority", "o_totalprice", stats=[*names, geometric],
                              order=["o_orderkey"])
    return out.select("x", *[F.round(n, 6).alias(n) for n in names], F.round("geometric_mean", 4).alias("geometric_mean"))


@query("group_mode", """
SELECT x, color, top AS "mode", any_ AS "any", all_ AS "all" FROM (
  SELECT l_returnflag AS x, l_linestatus AS color, l_discount AS top,
         row_number() OVER (PARTITION BY x, color ORDER BY count(*) DESC, l_discount) AS r,
         max(max(l_discount)) OVER (PARTITION BY x, color) <> 0 AS any_,
         min(min(l_discount)) OVER (PARTITION BY x, color) <> 0 AS all_
  FROM lineitem GROUP BY l_returnflag, l_linestatus, l_discount) WHERE r = 1
""")
def group_mode(t):
    """D3: most frequent discount (the least of equals), any and all, by (x, colour); pairs without rows left out."""
    out = A.categorical_stats(t("lineitem"), "l_returnflag", "l_discount", color="l_linestatus", stats=["mode", "any", "all"])
    return out.where(F.col("mode").isNotNull())


# --- profiling B3-B10 ----------------------------------------------------------------------

def _summary_sql(src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        parts.append(f"""SELECT {i + 1} AS "#", '{c}' AS "Column", '{kind}' AS "Type",
  CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "Unique",
  round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS "Missing" FROM {src}""")
    return "\nUNION ALL\n".join(parts)


ORDER_COLS = [("o_orderkey", "Numeric"), ("o_custkey", "Numeric"), ("o_orderstatus", "Categoric"),
              ("o_totalprice", "Numeric"), ("o_orderdate", "Categoric"), ("o_orderpriority", "Categoric")]


@query("column_summary", _summary_sql(ORDERS_NULLS, ORDER_COLS))
def column_summary(t):
    """#, Column, Type, Unique (null counted), Missing share -- one pass."""
    return B.column_summary(_orders_with_nulls(t))


def _non_negative(source: str, *columns: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "Column" FROM {source}
HAVING count(*) = count({c}) AND coalesce(min({c}) >= 0, true)""" for c in columns)


@query("non_negative_columns", _non_negative(
    "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
def non_negative_columns(t):
    """Numeric columns without negatives or nulls (all of lineitem's)."""
    return B.non_negative_columns(t("lineitem"))


@query("non_negative_with_nulls", _non_negative(
    "(SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice) FROM orders)",
    "o_orderkey", "o_custkey", "o_totalprice"))
def non_negative_with_nulls(t):
    """A numeric column with nulls is not a weight candidate."""
    return B.non_negative_columns(_orders_with_nulls(t))


@query("frequencies", """
SELECT o_orderpriority AS "Category", count(*) AS "Count" FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def frequencies(t):
    """Value counts of a column with at most 10 values."""
    return B.frequencies(t("orders"), "o_orderpriority")


@query("frequencies_guard", """
SELECT c_name AS "Category", count(*) AS "Count" FROM customer
WHERE c_name IS NOT NULL GROUP BY 1 HAVING (SELECT count(DISTINCT c_name) FROM customer) <= 10
""")
def frequencies_guard(t):
    """More than 10 distinct values gives no table (empty result)."""
    return B.frequencies(t("customer"), "c_name")


@query("metrics_numeric", """
SELECT * FROM (VALUES (1, 'R Squared (Recommended)'), (2, 'Mean Squared Error'),
  (3, 'Mean Absolute Error'), (4, 'Median Absolute Error'), (5, 'Mean Squared Log Error')) v("#", "Metric")
WHERE "#" < 5 OR (SELECT coalesce(min(c_acctbal) >= 0, true) FROM customer)
""")
def metrics_numeric(t):
    """Regression metrics; MSLE only when the target has no negative value."""
    return B.metric_suggestions(t("customer"), "c_acctbal", B.NUMERIC)


@query("metrics_binary", """
SELECT * FROM (VALUES (1, 'Log Loss (Recommended)'), (2, 'Accuracy'), (3, 'ROC Area Under Curve')) v("#", "Metric")
WHERE "#" < 3 OR (SELECT count(DISTINCT quality) + max(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) FROM labels) = 2
""")
def metrics_binary(t):
    """Classification metrics; AUC only for exactly two values (null counted)."""
    return B.metric_suggestions(t("labels"), "quality", B.CATEGORIC)


@query("value_ranges", """
SELECT 'l_quantity' AS "Column", round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max, round(avg(l_quantity), 6) AS mean FROM lineitem
UNION ALL SELECT 'l_discount', round(min(l_discount), 6), round(max(l_discount), 6), round(avg(l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_tax', round(min(l_tax), 6), round(max(l_tax), 6), round(avg(l_tax), 6) FROM lineitem
""")
def value_ranges(t):
    """Min / max / mean of numeric features in one pass."""
    return B.value_ranges(t("lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("category_values", """
SELECT DISTINCT l_shipmode_like AS value FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem)
""")
def category_values(t):
    """Sorted distinct values of a categoric feature."""
    li = t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("value"))
    return A.sorted_distinct(li, "value")


@query("high_cardinality", """
SELECT 'p_brand' AS "Column", CAST(count(DISTINCT p_brand) AS BIGINT) AS "Unique", 25 AS "limit",
       count(DISTINCT p_brand) > 25 AS top_only FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type), 10, count(DISTINCT p_type) > 10 FROM part
UNION ALL SELECT 'p_size', count(DISTINCT p_size), 25, count(DISTINCT p_size) > 25 FROM part
""")
def high_cardinality(t):
    """Columns that only show their top categories."""
    return B.high_cardinality(t("part"), {"p_brand": 25, "p_type": 10, "p_size": 25})


@query("default_row", """
SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount,
       CAST(NULL AS VARCHAR) AS l_returnflag, '' AS note FROM lineitem
""")
def default_row(t):
    """The what-if starting row -- means, null categories, empty text."""
    li = t("lineitem").withColumn("note", F.lit("x"))
    return B.default_row(li, ["l_quantity", "l_discount"], ["l_returnflag"], ["note"])


# --- sources A3-A5 -------------------------------------------------------------------------

@query("preview", """
SELECT * FROM orders ORDER BY o_orderkey LIMIT 25
""")
def preview(t):
    """First 25 rows in key order."""
    return paging.preview(t("orders"), key="o_orderkey")


@query("page", """
SELECT * FROM customer ORDER BY c_custkey
LIMIT 100 OFFSET 100 * least(greatest(3, 0), ((SELECT count(*) FROM customer) - 1) // 100)
""")
def page(t):
    """Page 3 of 100 rows (page index clamped to the last page)."""
    return paging.page(t("customer"), 3, key="c_custkey")


@query("page_clamped", """
SELECT * FROM customer ORDER BY c_custkey
LIMIT 100 OFFSET 100 * least(greatest(10000, 0), ((SELECT count(*) FROM customer) - 1) // 100)
""")
def page_clamped(t):
    """A4: a page past the end shows the last (short) page."""
    return paging.page(t("customer"), 10000, key="c_custkey")


@query("sorted_page", """
SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey
LIMIT 100 OFFSET 100 * least(2, ((SELECT count(*) FROM customer) - 1) // 100)
""")
def sorted_page(t):
    """A5: page 2 after sorting by a column, descending (key breaks ties)."""
    return paging.page(t("customer"), 2, key="c_custkey", sort_by="c_acctbal", ascending=False)


@query("last_sorted_page", """
SELECT * FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey
LIMIT 100 OFFSET 100 * (((SELECT count(*) FROM lineitem) - 1) // 100)
""")
def last_sorted_page(t):
    """A4/A5: the last page of the largest table in a sorted order; only the ranges that hold it are sorted."""
    index = paging.PageIndex(t("lineitem"), LINE_KEY, sort_by="l_shipdate", ascending=False)
    return index.page(index.last_page)


@query("row_numbers", """
SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS "#",
       CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS page
FROM customer
""")
def row_numbers(t):
    """Row number and page of every row."""
    return paging.numbered(t("customer").select("c_custkey"), key="c_custkey")


# --- row transforms C7, C8, C11 ------------------------------------------------------------

@query("category_strings", f"""
SELECT coalesce(CAST(o_orderstatus AS VARCHAR), 'nan') AS status, count(*) AS n FROM {ORDERS_NULLS} GROUP BY 1
""")
def category_strings(t):
    """Null category becomes the literal 'nan'."""
    from ..functions.expressions import category_string
    o = _orders_with_nulls(t)
    return o.groupBy(category_string("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("class_indicator", """
SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1
""")
def class_indicator(t):
    """Indicator of one class, averaged (the proportion used by dependence)."""
    from ..functions.expressions import indicator
    return t("lineitem").groupBy("l_returnflag").agg(F.avg(indicator("l_linestatus", "F")).alias("share"))


@query("class_weights", """
WITH c AS (SELECT o_orderstatus, count(*) AS nc FROM orders GROUP BY 1),
w AS (SELECT o_orderstatus, (SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * nc) AS class_weight FROM c)
SELECT o.o_orderstatus, round(w.class_weight, 6) AS class_weight, count(*) AS n
FROM orders o JOIN w USING (o_orderstatus) GROUP BY 1, 2
""")
def class_weights(t):
    """C11: balanced weights n/(k*n_c), attached to every row then summarised."""
    o = C.class_weights(t("orders"), "o_orderstatus")
    return o.groupBy("o_orderstatus", "class_weight").agg(F.count(F.lit(1)).alias("n"))


@query("select_columns", """
SELECT o_orderkey, o_totalprice, CAST(NULL AS DOUBLE) AS o_missing, '' AS o_comment FROM orders
""")
def select_columns(t):
    """Selecting columns by name; absent columns become null, absent text columns ''."""
    return C.select_columns(t("orders"), ["o_orderkey", "o_totalprice", "o_missing", "o_comment"],
                            text=["o_comment"])


@query("scatter_jitter", f"""
WITH pre AS (SELECT o_orderpriority AS x, o_totalprice AS y, o_orderstatus AS color,
                    {key_hash_sql('o_orderkey', salt='42')} / 4294967296.0 AS u FROM orders),
xo AS (SELECT x AS v, dense_rank() OVER (ORDER BY x) - 1 AS pos FROM
       (SELECT x FROM pre WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 25)),
co AS (SELECT color AS v, dense_rank() OVER (ORDER BY color) - 1 AS pos FROM
       (SELECT color FROM pre WHERE color IS NOT NULL GROUP BY color ORDER BY count(*) DESC, color LIMIT 10)),
k AS (SELECT count(*) AS k FROM co)
SELECT round(xo.pos + (0.8 / k.k) * (co.pos - (k.k / 2.0 - 0.5)) + (u * 2.0 - 1.0) * 0.5 / 2.0 / k.k, 6) AS x,
       round(y, 6) AS y, color
FROM pre JOIN xo ON pre.x = xo.v JOIN co ON pre.color = co.v, k WHERE y IS NOT NULL
""")
def scatter_jitter(t):
    """Scatter positions with the default jitter (0.5 for a categoric x), a hash of the order key."""
    return P.scatter_plot(t("orders"), "o_orderpriority", "o_totalprice", color="o_orderstatus", key="o_orderkey")


_PHI = ("CASE WHEN z >= 0 THEN 0.5 * (1 + e) ELSE 0.5 * (1 - e) END")


@query("normal_scores", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders),
z AS (SELECT o_orderkey, (o_totalprice - m) / sd AS z FROM orders, s),
t AS (SELECT o_orderkey, z, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z),
e AS (SELECT o_orderkey, z, 1.0 - (((((1.061405429 * t + -1.453152027) * t + 1.421413741) * t + -0.284496736) * t
        + 0.254829592) * t) * exp(-x * x) AS e FROM t)
SELECT o_orderkey, round(""" + _PHI + """, 6) AS cdf, round(exp(-0.5 * z * z) / sqrt(2 * pi()), 6) AS pdf FROM e
""")
def normal_scores(t):
    """2.9 math: normal cdf (Abramowitz-Stegun erf) and pdf of standardised order totals."""
    from ..functions.expressions import normal_cdf, normal_pdf
    o = t("orders")
    m = o.agg(F.avg("o_totalprice")).scalar()
    sd = o.agg(F.stddev_pop("o_totalprice")).scalar()
    z = (F.col("o_totalprice") - m) / sd
    return o.select("o_orderkey", normal_cdf(z).alias("cdf"), normal_pdf(z).alias("pdf"))
