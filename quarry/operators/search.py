"""Hyper-parameter search.

Trials are planned as a table: every dimension of a model's domain is a column
expression over the trial number, and the decoded parameters are the JSON text
of those columns.  The search takes planned trials in batches and fits and
scores them on the executors; the trial log is a table of one row per trial.
Proposals by a surrogate model are not offered: every trial is a seeded uniform
draw, and a finite space is walked until each of its points has been tried.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jobs import OutOfTime, within
from .models.catalogue import Dim

#: trials planned at a time
BATCH = 5

TRIAL_SCHEMA = T.StructType([
    T.StructField("experiment", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("trial", T.IntegerType()), T.StructField("params", T.StringType()),
    T.StructField("point", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("score_std", T.DoubleType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("total_seconds", T.DoubleType()), T.StructField("method", T.StringType()),
])


# --- H1-H3: the trial table -----------------------------------------------------------------

def raw_value(d: Dim, u: Column) -> Column:
    """H1: where a uniform number falls in a dimension; whole for integers and category numbers."""
    if d.kind == "categoric":
        return F.floor(u * len(d.bounds))
    lo, hi = d.bounds
    if d.kind == "integer":
        return F.floor(u * (hi - lo + 1)) + lo
    return u * (hi - lo) + lo


def parameter(d: Dim, raw: Column) -> Column:
    """H2: the parameter that a raw value stands for; a null category is an absent parameter."""
    if d.kind == "exponential":
        return F.exp(raw)
    if d.kind == "categoric":
        return F.element_at(F.array(*[F.lit(b) for b in d.bounds]), (raw + 1).cast("int"))
    if d.name == "mod__hidden_layer_sizes":
        return F.array(raw.cast("int"))
    return raw.cast("int") if d.kind == "integer" else raw


def plan_trials(spark: SparkSession, domain: Sequence[Dim], first: int, count: int, seed: int = 42) -> DataFrame:
    """H1/H2: trials ``first`` .. ``first + count - 1`` as (trial, point, params, one column per dimension).

    The draw of a dimension is a hash of (seed, trial, name): the same on any
    cluster.  ``point`` is the JSON of the raw values, equal for equal points.
    """
    trials = spark.range(first, first + count).withColumnRenamed("id", "trial")
    raws = {}
    for d in domain:
        h = F.xxhash64(F.lit(seed), F.col("trial"), F.lit(d.name))
        raws[d.name] = raw_value(d, F.shiftrightunsigned(h, 11) / float(1 << 53))
    values = [parameter(d, raws[d.name]).alias(d.name) for d in domain]
    points = [raws[d.name].cast("double").alias(d.name) for d in domain]
    empty = F.lit("{}")
    return trials.select("trial", (F.to_json(F.struct(*points)) if domain else empty).alias("point"),
                         (F.to_json(F.struct(*values)) if domain else empty).alias("params"), *values)


def decoded(params: str) -> dict:
    """Parameters of a planned trial for the model builders."""
    return {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(params).items()}


def space_size(domain: Sequence[Dim]) -> int | None:
    """H3: number of distinct points, or None when a dimension is continuous."""
    size = 1
    for d in domain:
        if d.kind in ("float", "exponential"):
            return None
        size *= len(d.bounds) if d.kind == "categoric" else d.bounds[1] - d.bounds[0] + 1
    return size


# --- H8-H10, W2: summaries of the trial log ------------------------------------------------

def training_curve(trials: DataFrame, scorer: str | None = None) -> DataFrame:
    """Best score so far per model, the improving trials, minutes if > 300 s."""
    w = Window.partitionBy("experiment", "model").orderBy("trial")
    best = F.max("score").over(w.rowsBetween(Window.unboundedPreceding, 0))
    prev = F.lag(best, 1).over(w)
    shown = F.col("score") if scorer == "r2" else F.abs(F.col("score"))
    best_shown = F.col("best") if scorer == "r2" else F.abs(F.col("best"))
    long = F.max("total_seconds").over(Window.partitionBy("experiment", "model")) > 300
    t = F.when(long, F.col("total_seconds") / 60.0).otherwise(F.col("total_seconds"))
    return (trials.withColumn("best", best).withColumn("improved", prev.isNull() | (F.col("best") > prev))
                  .select("experiment", "model", "trial", t.alias("time"), shown.alias("run_score"),
                          best_shown.alias("best_score"), "improved",
                          F.when(long, F.lit("min")).otherwise(F.lit("s")).alias("time_unit")))


def leaderboard(trials: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """H9: model, best validation score, holdout score, trials, total time."""
    board = trials.groupBy("experiment", "model").agg(
        F.max("score").alias("validation_score"), F.count(F.lit(1)).alias("trials"),
        F.max("total_seconds").alias("total_seconds"))
    if holdout is not None:
        board = board.join(holdout, ["experiment", "model"], "left")
    return board


def best_parameters(trials: DataFrame) -> DataFrame:
    """Parameters of the best trial (the first of equals), one row per (stage, parameter)."""
    best = trials.groupBy("experiment", "model").agg(
        F.max_by("params", F.struct("score", -F.col("trial"))).alias("params"))
    kv = best.select("experiment", "model",
                     F.explode(F.from_json("params", "map<string,string>")).alias("name", "value"))
    parts = F.split("name", "__")
    return kv.select("experiment", "model", F.element_at(parts, 1).alias("stage"),
                     F.concat_ws("__", F.slice(parts, 2, 10)).alias("parameter"), "value")


# --- the search (H4-H6) ----------------------------------------------------------------------

def planned(spark: SparkSession, domain: Sequence[Dim], first: int, tried: set[str], seed: int) -> Iterator[tuple[str, str]]:
    """(point, params) of untried trials, a batch planned at a time; ends when a finite space is used up."""
    size = space_size(domain)
    while size is None or len(tried) < size:
        for row in plan_trials(spark, domain, first, BATCH, seed).orderBy("trial").collect():
            if row["point"] not in tried:
                tried.add(row["point"])
                yield row["point"], row["params"]
        first += BATCH


def run_search(spark: SparkSession, experiment: str, model: str, domain: Sequence[Dim], evaluate,
               max_train_time: float = 600.0, max_trials: int | None = None, seed: int = 42,
               previous: Sequence[dict] = (), method: str = "cv") -> list[dict]:
    """H4/H5: evaluate planned trials until the time or the number of trials is spent.

    A trial that runs when the time is up is cancelled on the executors and
    leaves no row in the log.

    ``evaluate(params, best_mean, best_std) -> (mean, std, seconds)`` runs one
    trial on Spark.  ``previous`` trials are kept, and never repeated.
    """
    log = list(previous)
    spent = log[-1]["total_seconds"] if log else 0.0
    began = time.time()
    for point, params in planned(spark, domain, len(log), {t["point"] for t in log}, seed):
        if time.time() - began >= max_train_time or (max_trials is not None and len(log) >= max_trials):
            break
        leader = max(log, key=lambda t: t["score"], default=None)
        try:
            mean, std, seconds = within(spark, max_train_time - (time.time() - began), lambda: evaluate(
                decoded(params), leader and leader["score"], leader and leader["score_std"]))
        except OutOfTime:
            break
        log.append(dict(experiment=experiment, model=model, trial=len(log), params=params, point=point,
                        score=float(mean), score_std=float(std), seconds=float(seconds),
                        total_seconds=spent + time.time() - began, method=method))
    return log
