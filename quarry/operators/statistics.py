"""Statistics by group beyond the plain aggregates (D3): names with a finishing
formula, the mode, and a user's own aggregate in phases.

``FORMULAS`` are built from aggregates that Spark itself computes partially and
merges.  A :class:`UserAggregate` gives (partial, merge, finish): partial states
are made beside the data, merged in salted sub-groups and then by group, so no
task ever holds a group's values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 64              # sub-groups whose states meet before a group's do
HELD_GROUPS = 10_000    # groups a task gathers states for before it hands them on


def _skew(y: Column) -> Column:
    n = F.count(y)
    return F.when(n > 2, F.when(F.var_pop(y) > 0, F.skewness(y) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0))


def _kurt(y: Column) -> Column:
    n = F.count(y)
    return F.when(n > 3, F.when(F.var_pop(y) > 0, ((n + 1) * F.kurtosis(y) + 6) * (n - 1) / ((n - 2) * (n - 3)))
                  .otherwise(0.0))


# null where there are too few values: two for sem, three for skew, four for kurt
FORMULAS: dict[str, Callable[[Column], Column]] = {
    "sem": lambda y: F.stddev_samp(y) / F.sqrt(F.count(y)),
    "skew": _skew,
    "kurt": _kurt,
    "prod": lambda y: F.product(y),
    "ptp": lambda y: F.max(y) - F.min(y),
    "any": lambda y: F.coalesce(F.max(y != 0), F.lit(False)),
    "all": lambda y: F.coalesce(F.min(y != 0), F.lit(True)),
}


@dataclass(frozen=True)
class UserAggregate:
    """A statistic of a caller's own.

    ``partial(values) -> state``: a fixed number of floats from a non-empty array
    of non-null values; ``merge(states) -> state``: one state from a matrix with a
    state a row, in any order and any grouping; ``finish(state) -> float``.
    A group without values gets null.
    """
    name: str
    partial: Callable[[np.ndarray], Sequence[float]]
    merge: Callable[[np.ndarray], Sequence[float]]
    finish: Callable[[np.ndarray], float]


def user_statistic(df: DataFrame, by: Sequence[str], y: str, agg: UserAggregate) -> DataFrame:
    """(by..., name) for the groups of ``df`` that have a value."""
    fields = [T.StructField(c, df.schema[c].dataType) for c in by]
    state = T.StructField("__s", T.ArrayType(T.DoubleType()))
    rows = df.select(*by, F.col(y).cast("double").alias("__y")).where(F.col("__y").isNotNull())
    names = list(by)

    def gathered(held):
        import pandas as pd
        keys = [k for k, _ in held]
        out = pd.DataFrame({c: pd.Series([k[i] for k in keys], dtype=object) for i, c in enumerate(names)})
        out["__s"] = [np.asarray(s, dtype=float) for _, s in held]
        out["__salt"] = np.random.default_rng(len(held)).integers(0, SALTS, len(held))
        return out

    def first_states(batches):
        held: dict = {}
        for b in batches:
            for key, values in b.groupby(names, dropna=False, sort=False)["__y"]:
                key = tuple(None if k is None or k != k else k for k in (key if isinstance(key, tuple) else (key,)))
                state = np.asarray(agg.partial(values.to_numpy(float)), dtype=float)
                held[key] = state if key not in held else np.asarray(agg.merge(np.stack([held[key], state])), dtype=float)
            if len(held) > HELD_GROUPS:
                yield gathered(list(held.items()))
                held = {}
        if held:
            yield gathered(list(held.items()))

    def merged(pdf):
        out = pdf.iloc[:1].copy()
        out["__s"] = [np.asarray(agg.merge(np.stack(pdf["__s"].to_numpy())), dtype=float)]
        return out

    def finished(pdf):
        out = pdf.iloc[:1][names].copy()
        out[agg.name] = float(agg.finish(np.asarray(agg.merge(np.stack(pdf["__s"].to_numpy())), dtype=float)))
        return out

    salted = T.StructType([*fields, state, T.StructField("__salt", T.IntegerType())])
    states = rows.mapInPandas(first_states, salted).groupBy(*by, "__salt").applyInPandas(merged, salted)
    return states.groupBy(*by).applyInPandas(finished, T.StructType([*fields, T.StructField(agg.name, T.DoubleType())]))


def modes(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    """(by..., mode): the most frequent value, the least of equals; null without values."""
    counts = df.groupBy(*by, y).agg(F.count(y).alias("__n"))
    top = F.min(F.when(F.col("__n") > 0, F.struct((-F.col("__n")).alias("n"), F.col(y).alias("v"))))
    return counts.groupBy(*by).agg(top["v"].alias("mode"))
