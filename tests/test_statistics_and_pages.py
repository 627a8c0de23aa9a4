"""Statistics by group (D3) and pages of any depth (A4, A5) against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.aggregates import categorical_stats
from quarry.operators.statistics import UserAggregate
from quarry.sources.paging import PageIndex, page

SPREAD = UserAggregate("spread", lambda v: [v.min(), v.max()], lambda s: [s[:, 0].min(), s[:, 1].max()],
                       lambda s: s[1] - s[0])


def _groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(6)]), i) for i in range(600)]
    rows += [("one", 3, 600), ("none", None, 601)]
    return rows, spark.createDataFrame(rows, "g string, v int, i int").repartition(5)


def test_every_statistic_by_group(spark):
    import pandas as pd
    rows, df = _groups(spark)
    names = ["sem", "skew", "kurt", "prod", "ptp", "any", "all", "mode", "first", "last"]
    got = {r["x"]: r for r in categorical_stats(df, "g", "v", stats=[*names, SPREAD], order=["i"]).collect()}
    assert set(got) == {g for g, _, _ in rows}
    for g in got:
        v = pd.Series([x for k, x, _ in rows if k == g and x is not None], dtype=float)
        r = got[g]
        want = [v.sem(), v.skew(), v.kurt()] if len(v) > 3 else [None] * 3
        assert [r[n] for n in names[:3]] == (pytest.approx(want) if len(v) > 3 else want)
        assert (r["any"], r["all"]) == (bool((v != 0).any()), bool((v != 0).all()))
        if len(v):
            assert r["prod"] == v.prod() and r["ptp"] == r["spread"] == v.max() - v.min()
            assert (r["mode"], r["first"], r["last"]) == (v.mode()[0], v.iloc[0], v.iloc[-1])
        else:
            assert all(r[n] is None for n in ("ptp", "spread", "mode", "first", "last"))


def test_constant_groups_have_no_skew(spark):
    r = categorical_stats(spark.range(9).select(F.lit("k").alias("g"), F.lit(2.0).alias("v")), "g", "v",
                          stats=["skew", "kurt"]).first()
    assert (r["skew"], r["kurt"]) == (0.0, 0.0)


def test_statistics_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, v int")
    assert categorical_stats(empty, "g", "v", stats=["mode", "sem", SPREAD]).collect() == []


def test_unknown_statistic_is_refused(spark):
    with pytest.raises(ValueError):
        categorical_stats(spark.createDataFrame([("a", 1)], "g string, v int"), "g", "v", stats="nonsense")


def _table(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, None, "x", "x", "x", f"s{rng.randrange(40)}"]),
             dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(50))) for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, s string, d date").repartition(6)


@pytest.mark.parametrize("sort_by,up", [(None, True), ("s", True), ("s", False), ("d", False)])
def test_pages_are_slices_of_the_order(spark, sort_by, up):
    rows, df = _table(spark)
    at = {"s": 1, "d": 2}.get(sort_by)
    want = sorted(rows)
    if at is not None:      # nulls come first upwards, last downwards; the key breaks ties upwards
        want.sort(key=lambda r: (r[at] is not None, r[at] or ""), reverse=not up) if at == 1 else \
            want.sort(key=lambda r: r[at], reverse=not up)
    index = PageIndex(df, "k", size=70, sort_by=sort_by, ascending=up)
    assert index.total == 3000 and index.last_page == 42
    for number in (0, 17, 42, 99, -1):
        n = min(max(number, 0), 42)
        assert [tuple(r) for r in index.page(number).collect()] == want[n * 70:n * 70 + 70]


def test_a_deep_page_reads_only_its_ranges(spark):
    index = PageIndex(_table(spark)[1], "k", size=50)
    spans = np.diff([*index.starts, index.total])
    assert len(spans) > 100 and spans.max() < 120


def test_pages_of_tiny_tables(spark):
    empty = spark.createDataFrame([], "k long")
    assert page(empty, 3, "k").collect() == [] and PageIndex(empty, "k").last_page == 0
    assert [r[0] for r in page(spark.createDataFrame([(5,)], "k long"), 8, "k").collect()] == [5]
