"""Scoring (M1-M11) and ROC cumulative counts.

Metrics are aggregate Columns, so any number of them -- for any number of
folds or models (``by``) -- are computed in one pass over the predictions.
Every metric takes an optional weight column.  Scorer names follow the
reference's (greater is better: losses are negated).

The exact ROC curve needs cumulative counts in score order, the median its
ranks: both come from :mod:`.quantiles`, where no task holds all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cumulated, exact_quantiles, same_group

EPS = 1e-15

# Scorer names (the reference uses these library scorer ids).
REGRESSION_SCORERS = ("r2", "neg_mean_squared_error", "neg_mean_absolute_error",
                      "neg_median_absolute_error", "neg_mean_squared_log_error")
CLASSIFICATION_SCORERS = ("accuracy", "neg_log_loss", "f1", "roc_auc")


def _w(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def _wavg(x: Column, weight: str | None) -> Column:
    w = _w(weight)
    return F.sum(x * w) / F.sum(w)


def r2(y: str, p: str, weight: str | None = None) -> Column:
    """M1: 1 - SSE/SST (weighted), one pass.

    SST comes from central co-moments, which keep their digits when the target
    is large beside its spread (sum(y^2) - sum(y)^2 / n does not).
    """
    w, yc, pc = _w(weight), F.col(y).cast("double"), F.col(p).cast("double")
    sse = F.sum(w * (yc - pc) * (yc - pc))
    n = F.count(w * yc)
    if weight is None:
        return 1.0 - sse / (F.var_pop(yc) * n)
    return 1.0 - sse / (n * (F.covar_pop(w * yc, yc) - F.avg(w * yc) * F.covar_pop(w, yc) / F.avg(w)))


def mse(y: str, p: str, weight: str | None = None) -> Column:
    d = F.col(y).cast("double") - F.col(p).cast("double")
    return _wavg(d * d, weight)


def mae(y: str, p: str, weight: str | None = None) -> Column:
    return _wavg(F.abs(F.col(y).cast("double") - F.col(p).cast("double")), weight)


def median_absolute_error(df: DataFrame, y: str, p: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """M4: (by..., medae), exact; weighted: the least error that half of the weight doesn't exceed."""
    d = F.abs(F.col(y).cast("double") - F.col(p).cast("double"))
    q = exact_quantiles(df, by, d, [0.5], None if weight is None else _w(weight))
    return q.select(*by, F.col("q")[0].alias("medae"))


def msle(y: str, p: str, weight: str | None = None) -> Column:
    """M5: null where a target or prediction is -1 or less, for which the loss is undefined."""
    yc, pc = F.col(y).cast("double"), F.col(p).cast("double")
    d = F.log1p(yc) - F.log1p(pc)
    return F.when(F.min(F.least(yc, pc)) > -1.0, _wavg(d * d, weight))


def accuracy(y: str, p: str, weight: str | None = None) -> Column:
    return _wavg((F.col(y) == F.col(p)).cast("double"), weight)


def log_loss(p_true: str, weight: str | None = None) -> Column:
    """M7: mean of -ln(probability of the true class), clipped at 1e-15."""
    q = F.least(F.greatest(F.col(p_true).cast("double"), F.lit(EPS)), F.lit(1.0 - EPS))
    return _wavg(-F.log(q), weight)


def f1(y: str, p: str, positive=1, weight: str | None = None) -> Column:
    """M8: binary F1 of the positive class."""
    w = _w(weight)
    tp = F.sum(F.when((F.col(y) == positive) & (F.col(p) == positive), w).otherwise(0.0))
    fp = F.sum(F.when((F.col(y) != positive) & (F.col(p) == positive), w).otherwise(0.0))
    fn = F.sum(F.when((F.col(y) == positive) & (F.col(p) != positive), w).otherwise(0.0))
    return 2.0 * tp / (2.0 * tp + fp + fn)


def regression_scores(df: DataFrame, y: str, p: str, weight: str | None = None,
                      by: Sequence[str] = ()) -> DataFrame:
    """All regression scorers (losses negated): one aggregate, and the exact median's."""
    out = df.groupBy(*by).agg(
        r2(y, p, weight).alias("r2"),
        (-mse(y, p, weight)).alias("neg_mean_squared_error"),
        (-mae(y, p, weight)).alias("neg_mean_absolute_error"),
        (-msle(y, p, weight)).alias("neg_mean_squared_log_error"))
    med = median_absolute_error(df, y, p, weight, by)
    if not by:
        return out.withColumn("neg_median_absolute_error", -med.select("medae").scalar())
    med = med.select(*[F.col(c).alias(f"__m{i}") for i, c in enumerate(by)], (-F.col("medae")).alias("neg_median_absolute_error"))
    return out.join(med, same_group(by, [f"__m{i}" for i in range(len(by))]), "left").drop(*[f"__m{i}" for i in range(len(by))])


def scorer_column(name: str, y: str, p: str, p_true: str | None = None,
                  weight: str | None = None, positive=1) -> Column:
    """Aggregate Column for one scorer name.

    ``roc_auc`` and ``neg_median_absolute_error`` are no aggregates: see
    :func:`roc_auc` and :func:`median_absolute_error`.
    """
    table = {
        "r2": lambda: r2(y, p, weight),
        "neg_mean_squared_error": lambda: -mse(y, p, weight),
        "neg_mean_absolute_error": lambda: -mae(y, p, weight),
        "neg_mean_squared_log_error": lambda: -msle(y, p, weight),
        "accuracy": lambda: accuracy(y, p, weight),
        "neg_log_loss": lambda: -log_loss(p_true, weight),
        "f1": lambda: f1(y, p, positive, weight),
    }
    if name not in table:
        raise ValueError(f"unknown scorer {name!r}")
    return table[name]()


def probability_of(prob_array: str, classes: Sequence, value: Column) -> Column:
    """Probability of ``value`` from an array aligned with ``classes``."""
    arr = F.array(*[F.lit(c) for c in classes])
    return F.element_at(F.col(prob_array), F.array_position(arr, value).cast("int"))


# --- ROC (W3, M9, M11) --------------------------------------------------------------------

def roc_curve(df: DataFrame, label: Column | str, score: str, weight: str | None = None,
              by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC points, one per distinct score (threshold), per ``by`` group.

    ``label`` is a boolean/0-1 column (positive class).  Columns:
    ``by..., threshold, tp, fp, tpr, fpr`` plus ``area``: this point's
    trapezoid, whose sum is the AUC.
    """
    lab = F.col(label) if isinstance(label, str) else label
    w = _w(weight)
    is_pos = lab.cast("boolean")
    per = (df.groupBy(*by, F.col(score).cast("double").alias("threshold"))
             .agg(F.sum(F.when(is_pos, w).otherwise(0.0)).alias("p"),
                  F.sum(F.when(~is_pos, w).otherwise(0.0)).alias("n")))
    cum = cumulated(per, by, "threshold", ["p", "n"], descending=True)
    return cum.select(
        *by, "threshold", F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"),
        (F.col("p_upto") / F.col("p_all")).alias("tpr"), (F.col("n_upto") / F.col("n_all")).alias("fpr"),
        (F.col("n") / F.col("n_all") * (2.0 * F.col("p_upto") - F.col("p")) / (2.0 * F.col("p_all"))).alias("area"))


def roc_auc(df: DataFrame, label: Column | str, score: str, weight: str | None = None,
            by: Sequence[str] = ()) -> DataFrame:
    """M9: area under the exact ROC curve (trapezoids), per ``by`` group."""
    return roc_curve(df, label, score, weight, by).groupBy(*by).agg(F.sum("area").alias("roc_auc"))


def one_vs_rest_roc(df: DataFrame, y: str, prob_cols: dict, weight: str | None = None) -> DataFrame:
    """One ROC curve per class (class -> probability column), classes sorted."""
    parts = [F.struct(F.lit(str(c)).alias("class"), (F.col(y).cast("string") == F.lit(str(c))).alias("__pos"),
                      F.col(pc).cast("double").alias("__s")) for c, pc in sorted(prob_cols.items())]
    keep = [weight] if weight else []
    long = df.select(*keep, F.inline(F.array(*parts)))
    return roc_curve(long, "__pos", "__s", weight, by=["class"])


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """``true, predicted, count, share`` over all (sorted) class pairs.

    ``share`` is the count divided by the number of rows of that true class.
    """
    counts = df.groupBy(F.col(y).alias("true"), F.col(p).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    labels = counts.select(F.array_sort(F.array_union(F.collect_set("true"), F.collect_set("predicted"))))
    arr = labels.scalar()
    # classes x classes grid (bounded by the number of classes)
    grid = (df.sparkSession.range(1).select(F.explode(arr).alias("true"))
              .select("true", F.explode(arr).alias("predicted")))
    full = grid.join(counts, ["true", "predicted"], "left").fillna({"count": 0})
    row_total = F.sum("count").over(Window.partitionBy("true"))
    return full.withColumn("share", F.when(row_total > 0, F.col("count") / row_total))
